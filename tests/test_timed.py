"""Timed states against plain readings, however the input is cut; supervision of streams."""

import random
import threading
from dataclasses import replace

import pandas as pd
import pytest

from spreadlake import config as cfg
from spreadlake.operators import watch
from spreadlake.sources.landed import stream_table
from spreadlake.streaming import cadence, position_watch, timed
from spreadlake.streaming.shops import Shop, Supervisor

DAY = 86_400_000_000


class Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


class Handle:
    """One key's state and timers."""

    def __init__(self):
        self.value, self.timers = Value(), set()

    def getValueState(self, name, schema):
        return self.value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def drive(processor, rows, cuts, closed, columns):
    """Rows (first is the time in microseconds) in batches; the watermark follows their times
    and ends at `closed`."""
    handle, told, seen = Handle(), [], 0
    processor.init(handle)

    def fire(upto):
        for at in sorted(t for t in handle.timers if t * 1000 <= upto):
            handle.timers.discard(at)
            for frame in processor.handleExpiredTimer(("k",), None, Expired(at)):
                told.extend(frame.itertuples(index=False, name=None))

    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        batch = rows[a:b]
        if not batch:
            continue
        frame = pd.DataFrame(batch, columns=columns)
        frame["at"] = pd.to_datetime(frame["at"], unit="us")
        for out in processor.handleInputRows(("k",), iter([frame.iloc[: len(batch) // 2], frame.iloc[len(batch) // 2:]]), None):
            told.extend(out.itertuples(index=False, name=None))
        seen = max(seen, *(r[0] for r in batch))
        fire(min(seen, closed))
    fire(closed)
    return told


def micros(rows, *at):
    return [tuple(pd.Timestamp(x).value // 1000 if i in at else None if x is not None and x != x else x for i, x in enumerate(r)) for r in rows]


@pytest.mark.parametrize("seed", range(8))
def test_misses_expire_however_the_input_is_cut(seed):
    rnd = random.Random(seed)
    times = sorted(rnd.sample(range(0, 40 * DAY, 1_000_003), 20))
    closed = times[-1] + rnd.choice([0, 5 * DAY])
    want = [(a, a + 3 * DAY) for a, b in zip(times, [*times[1:], None]) if (b is not None and b > a + 3 * DAY) or (b is None and a + 3 * DAY <= closed)]
    for _ in range(3):
        cuts = sorted(rnd.sample(range(1, 20), rnd.randrange(5)))
        got = drive(timed.Misses(3), [(t,) for t in times], cuts, closed, ["at"])
        assert [(a, b) for _, a, b in micros(got, 1, 2)] == want


def test_an_older_try_does_not_renew_a_miss():
    got = drive(timed.Misses(3), [(5 * DAY,), (4 * DAY,)], [1], 9 * DAY, ["at"])
    assert micros(got, 1, 2) == [("k", 5 * DAY, 8 * DAY)]


@pytest.mark.parametrize("seed", range(8))
def test_products_fall_due_by_their_tier(seed):
    rnd = random.Random(seed)
    base = cfg.EngineConfig()
    config = replace(base, venue=replace(base.venue, refresh_minutes_hot=600, refresh_minutes_warm=1500, refresh_minutes_cold=4000))
    floor, near = config.filters.min_profit, config.venue.near_miss
    best, minutes = rnd.choice([(floor + 1, 600), (floor - near / 2, 1500), (floor - near - 1, 4000), (None, 4000)])
    rows = [(0, cadence.VARIANT, "a", None), (0, cadence.VARIANT, "b", None), (0, cadence.WATCH, None, best)]
    times = sorted(rnd.sample(range(1, 20 * DAY, 1_000_003), 40))
    quotes = [(t, cadence.QUOTE, rnd.choice("ab"), None) for t in times]
    closed, fetched, want = times[-1] + rnd.choice([0, 5 * DAY]), {}, [(0, 600)]
    for row, after in zip(quotes, [*times[1:], None]):
        fetched[row[2]] = row[0]
        due = min(fetched.get(x, -1) for x in "ab") + minutes * 60_000_000
        if len(fetched) == 2 and due >= row[0] and (due < after if after is not None else due <= closed):
            want.append((due, minutes))
    for _ in range(3):
        cuts = sorted(rnd.sample(range(1, 43), rnd.randrange(6)))
        got = drive(timed.Cadence(config), rows + quotes, cuts, closed, ["at", "kind", "variant_id", "best_profit"])
        # the tier is not known yet when the first variant has no quote
        assert [(a, m) for _, a, m in micros(got, 1)] == want


def test_a_slower_tier_takes_a_product_back():
    config = cfg.EngineConfig()
    rows = [(0, cadence.VARIANT, "a", None), (0, cadence.QUOTE, "a", None), (2 * DAY, cadence.WATCH, None, None), (2 * DAY, cadence.QUOTE, "a", None)]
    got = drive(timed.Cadence(config), rows, [2], 10 * DAY, ["at", "kind", "variant_id", "best_profit"])
    hot, cold = config.venue.refresh_minutes_hot, config.venue.refresh_minutes_cold
    assert micros(got, 1) == [("k", 0, hot), ("k", hot * 60_000_000, hot), ("k", 2 * DAY + cold * 60_000_000, cold)]


LINE = ["at", "kind", "bid", "profit", "move", "until"]


def checks(*rows, until=None):
    stop = None if until is None else pd.Timestamp(until, unit="us")
    return [(at, kind, bid, None if bid is None else bid - 80.0, 20.0, stop) for at, kind, bid in rows]


def test_a_report_that_got_lost_comes_up_again():
    rows = checks((1, 0, 100.0), (2, 0, 130.0), (3, 0, 131.0), (3, 1, None), (4, 0, 132.0), (5, 0, None), (5, 1, None), (6, 0, None))
    for cuts in ([], [2], [1, 3, 4, 6]):
        got = micros(drive(timed.Watched(), rows, cuts, 10, LINE), 1)
        assert got == [("k", 2, 100.0, 130.0, watch.MOVED), ("k", 3, 100.0, 131.0, watch.MOVED), ("k", 5, 132.0, None, watch.GONE)]


def test_late_receipts_late_checks_and_the_end_of_a_watch():
    rows = checks((10, 0, 100.0), (20, 0, 130.0), (30, 0, 160.0), (20, 1, None), (5, 0, 131.0), (40, 0, 60.0), until=35_000)
    got = micros(drive(timed.Watched(), rows, [3, 4, 5], 100_000, LINE), 1)
    # the receipt of 20 comes after the report of 30; the late check is judged against 130
    assert got == [("k", 20, 100.0, 130.0, watch.MOVED), ("k", 30, 100.0, 160.0, watch.MOVED), ("k", 40, 131.0, 60.0, watch.MOVED),
                   ("k", 35_000, 131.0, None, position_watch.ENDED)]
    assert drive(timed.Watched(), checks((50_000, 0, 100.0), until=35_000), [], 0, LINE) == []


def test_events_of_single_checks():
    of = position_watch.event_of
    assert of(None, 5.0, 1.0, 10) == watch.BASELINE and of((None, None), None, None, 10) == watch.NONE
    assert of((5.0, 1.0), 4.0, -1.0, 10) == watch.UNDERWATER and of((5.0, -1.0), 4.0, -2.0, 10) == watch.NONE
    assert of((5.0, 1.0), 0.0, None, 10) == watch.UNDERWATER and of((0.0, None), 4.0, -1.0, 10) == watch.NONE


def test_a_failing_stream_is_started_again_with_growing_delay(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a",), ("b",)], "k string").write.parquet(folder)
    done, tries, lock = {"good": 0, "bad": 0}, [], threading.Lock()

    def good(batch, batch_id):
        done["good"] += batch.count()

    def bad(batch, batch_id):
        with lock:
            tries.append(batch_id)
        if len(tries) < 3:
            raise ValueError("broken shop")
        done["bad"] += batch.count()

    stream = stream_table(spark, folder, "k string")
    watched = Supervisor(spark, {"good": Shop(stream, good), "bad": Shop(stream, bad)}, str(tmp_path), first=0.05).start()
    try:
        assert watched.await_end(60)
        assert done == {"good": 2, "bad": 2} and tries == [0, 0, 0]
        assert watched.restarts == {"good": 0, "bad": 2} and "broken shop" in watched.errors["bad"]
    finally:
        watched.stop()
