"""Streams: state over batches, repeated batches, delivery receipts."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spreadlake import config as cfg
from spreadlake.sources.landed import stream_table
from spreadlake.streaming import alerts, batches, changes, position_watch
from spreadlake.streaming.batches import BatchOutput, StateLog, run_to_end

T0 = datetime(2026, 8, 1, tzinfo=timezone.utc)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def _feed(spark, tmp_path, schema, step, batches_of_rows):
    """Each list of rows is one run of the stream on one checkpoint."""
    for rows in batches_of_rows:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_to_end(stream_table(spark, str(tmp_path / "in"), schema), step, str(tmp_path / "checkpoint"))


def _alerts(spark, tmp_path):
    out = BatchOutput(spark, str(tmp_path / "out"))
    state = StateLog(spark, str(tmp_path / "state"), alerts.STATE, ["key"], "at")
    return out, alerts.step(state, out, 10.0)


def test_alert_comes_again_until_delivered(spark, tmp_path):
    out, step = _alerts(spark, tmp_path)
    offer = lambda m, p=50.0, s=True: ("k", at(m), "offer", p, s, "x")
    _feed(spark, tmp_path, alerts.INPUT, step, [
        [offer(0)], [offer(10)], [("k", at(11), "delivered", 50.0, True, None), offer(12)], [offer(20, 59.0)],
        [offer(30, 60.0), ("k", at(31), "delivered", 60.0, True, None)], [offer(40, 61.0), ("k", at(41), "gone", None, None, None), offer(42, 61.0)],
    ])
    got = sorted((r.at.replace(tzinfo=timezone.utc), r.reason) for r in out.read().collect())
    assert got == [(at(0), "new"), (at(10), "new"), (at(30), "profit_change"), (at(42), "restock")]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    out, step = _alerts(spark, tmp_path)
    first = spark.createDataFrame([("k", at(0), "delivered", 50.0, True, None)], alerts.INPUT)
    second = spark.createDataFrame([("k", at(5), "offer", 70.0, True, "x"), ("k", at(6), "delivered", 70.0, True, None)], alerts.INPUT)
    step(first, 0)
    step(second, 1)
    once = sorted(map(str, out.read().collect()))
    step(second, 1)
    assert sorted(map(str, out.read().collect())) == once and len(once) == 1


def test_an_unfinished_state_write_is_ignored(spark, tmp_path):
    state = StateLog(spark, str(tmp_path / "s"), "k string, at timestamp, n int", ["k"], "at")
    rows = lambda n, m: spark.createDataFrame([("a", at(m), n)], "k string, at timestamp, n int")
    state.put(0, rows(1, 0))
    state.put(1, rows(2, 1))
    (tmp_path / "s" / "delta" / "1" / "_SUCCESS").unlink()
    assert [r.n for r in state.before(5).collect()] == [1]


def test_folding_keeps_the_newest_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "FOLD_EVERY", 3)
    state = StateLog(spark, str(tmp_path / "s"), "k string, at timestamp, n int", ["k"], "at")
    for b in range(7):
        state.put(b, spark.createDataFrame([("a", at(b), b), (f"b{b}", at(b), b)], "k string, at timestamp, n int"))
    assert (tmp_path / "s" / "full" / "5" / "_SUCCESS").exists()
    got = {r.k: r.n for r in state.before(7).collect()}
    assert got == {"a": 6, **{f"b{b}": b for b in range(7)}}
    assert {r.k: r.n for r in state.before(2).collect()} == {"a": 1, "b0": 0, "b1": 1}


def test_position_watch_over_batches(spark, tmp_path):
    out = BatchOutput(spark, str(tmp_path / "out"))
    state = StateLog(spark, str(tmp_path / "state"), position_watch.STATE, ["variant_id"], "at")
    positions = spark.createDataFrame([("v", 60.0, 20.0, at(100)), ("w", 60.0, 20.0, None)], position_watch.POSITIONS)
    step = position_watch.step(state, out, positions, cfg.SHIPPED)
    _feed(spark, tmp_path, position_watch.INPUT, step, [
        [("v", at(0), 90.0), ("other", at(0), 90.0), ("v", at(1), 85.0)], [("v", at(2), 79.0), ("v", at(3), None)], [("v", at(4), None)],
        [("v", at(5), 79.0), ("v", at(6), 99.0), ("v", at(101), 10.0)],
    ])
    got = [(r.at.replace(tzinfo=timezone.utc), r.last_bid, r.bid, r.event) for r in out.read().orderBy("at").collect()]
    assert got == [
        (at(2), 85.0, 79.0, "underwater"), (at(3), 79.0, None, "bid_gone"), (at(5), None, 79.0, "bid_back"), (at(6), 79.0, 99.0, "bid_moved"),
    ]


def test_changes_over_batches(spark, tmp_path):
    out = BatchOutput(spark, str(tmp_path / "out"))
    step = changes.step(StateLog(spark, str(tmp_path / "state"), changes.STATE, changes.KEYS, "at"), out)
    _feed(spark, tmp_path, changes.INPUT, step, [
        [("s", "u", at(0), 10.0, True)], [("s", "u", at(1), 9.995, False), ("s", "u", at(2), 9.0, False)], [("s", "u", at(3), 9.0, True)],
    ])
    got = [(r.is_new, r.price_dropped, r.restocked) for r in out.read().orderBy("at").collect()]
    assert got == [(True, False, False), (False, True, False), (False, False, True)]


def test_one_shop_failing_leaves_the_others_running(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a",)], "k string").write.parquet(folder)
    done = []

    def good(batch, batch_id):
        done.append(batch.count())

    def bad(batch, batch_id):
        raise ValueError("broken shop")

    stream = stream_table(spark, folder, "k string")
    running = batches.start_per_shop({"good": (stream, good, 1), "bad": (stream, bad, 1)}, str(tmp_path))
    try:
        with pytest.raises(Exception):
            running["bad"].awaitTermination(60)
        running["good"].processAllAvailable()
        assert done == [1] and running["good"].isActive and not running["bad"].isActive
    finally:
        for q in running.values():
            q.stop()
