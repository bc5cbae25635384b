"""State tables, reviews, alerts, reports."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spreadlake import config as cfg
from spreadlake.operators import alerts, review, state
from spreadlake.operators.state import VersionedTable
from spreadlake.plans import jobs

NOW = datetime(2026, 8, 1, 12, tzinfo=timezone.utc)


def _store(spark, tmp_path):
    return jobs.Store(spark, str(tmp_path / "store"))


def test_versions_do_not_disturb_readers(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k string, n int", ("k",))
    assert table.read().count() == 0
    table.replace(spark.createDataFrame([("a", 1)], "k string, n int"))
    old = table.read()
    table.replace(table.read().withColumn("n", F.col("n") + 1))
    assert [r.n for r in old.collect()] == [1] and [r.n for r in table.read().collect()] == [2]


def test_a_second_writer_of_one_version_fails(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k string", ("k",))
    table.replace(spark.createDataFrame([("a",)], "k string"))
    late = VersionedTable(spark, str(tmp_path / "t"), "k string", ("k",))
    late.version = lambda: 0
    with pytest.raises(RuntimeError):
        late.replace(spark.createDataFrame([("b",)], "k string"))


def test_a_version_without_pointer_is_not_read(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k string", ("k",))
    table.replace(spark.createDataFrame([("a",)], "k string"))
    spark.createDataFrame([("half", 0)], "k string, bucket int").write.partitionBy("bucket").parquet(str(tmp_path / "t" / "v2"))
    assert [r.k for r in table.read().collect()] == ["a"]
    table.replace(spark.createDataFrame([("b",)], "k string"))
    assert [r.k for r in table.read().collect()] == ["b"]


def test_a_put_reads_and_writes_the_buckets_of_its_keys(spark, tmp_path):
    import os

    table = VersionedTable(spark, str(tmp_path / "t"), "k string, n int", ("k",), buckets=8, keep=3)
    table.replace(spark.createDataFrame([(f"k{i}", i) for i in range(200)], "k string, n int"))
    read = []

    def merge(old, new):
        read.extend(old.inputFiles())
        return state.keep_latest(old.withColumn("at", F.lit(0)), new.withColumn("at", F.lit(1)), ["k"], "at").drop("at")

    def buckets(version):
        return {n for n in os.listdir(tmp_path / "t" / f"v{version}") if n.startswith("bucket=")}

    table.put(spark.createDataFrame([("k7", -7)], "k string, n int"), merge)
    assert len(buckets(1)) == 8 and len(buckets(2)) == 1
    assert read and all(f"/v1/{[*buckets(2)][0]}/" in f for f in read)
    want = {f"k{i}": i for i in range(200)} | {"k7": -7}
    assert {r.k: r.n for r in table.read().collect()} == want
    assert {r.k: r.n for r in table.read(1).collect()} == want | {"k7": 7}
    # a bucket that loses all its rows is empty, not what it was
    for i in range(200):
        want.pop(f"k{i}") if i % 2 else None
    table.put(spark.createDataFrame([(f"k{i}",) for i in range(1, 200, 2)], "k string"), lambda old, gone: state.drop_keys(old, gone, ["k"]))
    table.put(spark.createDataFrame([(f"k{i}",) for i in range(0, 200, 2)], "k string"), lambda old, gone: state.drop_keys(old, gone, ["k"]))
    assert table.read().count() == 0 and {r.k: r.n for r in table.read(3).collect()} == want
    # what no kept version shows goes
    for n in range(5):
        table.put(spark.createDataFrame([("k7", n)], "k string, n int"), merge)
    assert [r.n for r in table.read().collect()] == [4] and table.version() == 9
    assert {int(n[1:]) for n in os.listdir(tmp_path / "t") if n.startswith("v")} == {4, 6, 7, 8, 9}
    assert table.put(spark.createDataFrame([], "k string, n int"), merge) == 9


def test_review_round_trip(spark, tmp_path):
    store = _store(spark, tmp_path)
    schema = "created_at timestamp, retailer string, url string, style_code string, reason string, detail string"
    rows = [(NOW, "a", "https://s/a", "A-1", review.LOW_CONFIDENCE, "{}"), (NOW, "b", "https://s/b", "B-2", review.SIZE_CONFLICT, "{}"),
            (NOW + timedelta(1), "c", "https://s/a", "A-1", review.LOW_CONFIDENCE, "{}")]
    jobs.add_reviews(store, spark.createDataFrame(rows, schema))
    jobs.add_reviews(store, spark.createDataFrame(rows[:1], schema))
    low = review.listing(jobs.reviews(store), reason=review.LOW_CONFIDENCE).collect()
    assert [(r.retailer, r.url) for r in low] == [("a", "https://s/a")]
    ids = spark.createDataFrame([(low[0].review_id,)], "review_id string")
    assert review.resolve(jobs.reviews(store), ids, F.lit(NOW)).count() == 1
    jobs.resolve_reviews(store, ids, F.lit(NOW))
    assert review.resolve(jobs.reviews(store), ids, F.lit(NOW)).count() == 0
    assert review.listing(jobs.reviews(store), reason=review.LOW_CONFIDENCE).count() == 0
    assert review.listing(jobs.reviews(store), resolved=True).first().review_id == low[0].review_id
    assert [(r.reason, r.n) for r in review.counts_by_reason(jobs.reviews(store)).collect()] == [(review.SIZE_CONFLICT, 1)]
    jobs.add_reviews(store, spark.createDataFrame([(NOW + timedelta(2), *rows[0][1:])], schema))
    assert review.listing(jobs.reviews(store), reason=review.LOW_CONFIDENCE).count() == 1


def test_alert_reasons(spark):
    known = spark.createDataFrame([("dup", 50.0, True), ("gone", 50.0, False), ("moved", 50.0, True)], "key string, last_profit double, was_in_stock boolean")
    opps = spark.createDataFrame(
        [("new", 1.0, True), ("dup", 59.99, True), ("gone", 50.0, True), ("moved", 40.0, True), ("gone", 50.0, False)],
        "key string, gate_profit double, in_stock boolean",
    )
    got = sorted((r.key, r.reason) for r in alerts.with_reason(opps, known, 10.0).collect())
    assert got == [("dup", "duplicate"), ("gone", "duplicate"), ("gone", "restock"), ("moved", "profit_change"), ("new", "new")]


def test_failed_delivery_leaves_no_record(spark, tmp_path):
    store = _store(spark, tmp_path)
    sent = spark.createDataFrame([("a", 10.0, True, "text")], "key string, gate_profit double, in_stock boolean, payload string")
    jobs.record_alerts(store, sent.limit(0), F.lit(NOW))
    assert store.alerts.read().count() == 0
    jobs.record_alerts(store, sent, F.lit(NOW))
    jobs.record_alerts(store, sent.withColumn("gate_profit", F.lit(30.0)), F.lit(NOW + timedelta(1)))
    [row] = store.alerts.read().withColumn("gap", F.col("last_alerted") - F.col("first_alerted")).collect()
    assert row.last_profit == 30.0 and row.gap == timedelta(1)
    jobs.mark_out_of_stock(store, spark.createDataFrame([("a",), ("unknown",)], "key string"))
    assert [r.was_in_stock for r in store.alerts.read().collect()] == [False]


def _alert_row(spark, **values):
    row = {
        "retailer": "shop", "url": "https://x/y", "name": "Test Shoe", "title": "Test Shoe", "style_code": "HQ2010-005", "category": "sneakers",
        "price": 100.0, "landed_cost": 100.0, "discount_pct": 0.0, "sale_discount_pct": 0.0, "extra_cost_eur": 0.0, "on_sale": False,
        "price_verified": True, "size_stock_unverified": False, "size_label": "42", "us_size": "8.5", "variant_id": "v1", "buy_note": "",
        "stock_note": "", "prefer_note": "", "reason": "new", "confidence": 1.0, "size_match_method": "size chart", "url_key": "slug",
        "style_id": "S", "product_id": "p1", "highest_bid": 150.0, "lowest_ask": 170.0, **values,
    }
    df = spark.createDataFrame([row], ", ".join(
        f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in row.items()))
    nulls = {"num_asks": "int", "num_bids": "int", "sales_72h": "int", "last_sale": "double"}
    from spreadlake.operators.opportunity import build

    c = cfg.SHIPPED
    return build(df.withColumns({k: F.lit(None).cast(t) for k, t in nulls.items()}), c).select(alerts.alert_text(c).alias("t")).first().t


def test_alert_wording(spark):
    plain = _alert_row(spark)
    assert "size 42 EU (8.5 US)" in plain and "does not say" not in plain and "(new)" not in plain
    assert "At the bid: 150.00 EUR, 122.00 paid out, 22.00 gained" in plain
    unsure = _alert_row(spark, size_stock_unverified=True, reason="restock")
    assert "by its bid - the shop does not say" in unsure and "(restock)" in unsure
    boxed = _alert_row(spark, size_label=None, us_size=None, title="PS5 (US Plug)")
    assert "no sizes" in boxed and "sealed only" in boxed and "US Plug" in boxed and "size 42" not in boxed and "None" not in boxed
    costed = _alert_row(spark, discount_pct=0.1, extra_cost_eur=13.0, price_verified=False, buy_note="forwarded")
    assert "100.00 EUR, 10% off, forwarding 13.00, in all 100.00, as listed, page not read" in costed and "Buying: forwarded" in costed
