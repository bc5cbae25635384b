"""The whole scan over the small data set."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spreadlake import config as cfg
from spreadlake.plans.scan import ScanInputs, scan
from tests import fixtures


def _config():
    shops = tuple(cfg.RetailerPolicy(retailer=r) for r in ("alpha", "boxes", "volts"))
    shipped = cfg.SHIPPED
    return replace(shipped, retailers=shops, filters=replace(shipped.filters, max_retail_price=1000.0))


@pytest.fixture(scope="module")
def result(spark):
    config = _config()
    t = fixtures.tables(spark)
    inputs = ScanInputs(
        listing=t["listing"], policy=config.policy_frame(spark), catalog=t["catalog"], variants=t["variants"],
        quotes=t["quotes"],
    )
    return scan(inputs, config, F.lit(fixtures.NOW))


def test_one_sized_and_one_sizeless_opportunity(result):
    rows = {r["key"]: r for r in result.opportunities.collect()}
    assert set(rows) == {"alpha|v-aj1-8.5|42", "boxes|v-falcon"}
    assert rows["alpha|v-aj1-8.5|42"]["gate_profit"] == pytest.approx(38.60)
    assert rows["boxes|v-falcon"]["gate_profit"] == pytest.approx(77.40)


def test_unconfirmed_region_goes_to_review(result):
    rows = result.reviews.collect()
    assert [(r["retailer"], r["reason"]) for r in rows] == [("volts", "region_marker_unconfirmed")]


def test_alert_text_and_stats(result):
    texts = {r["key"]: r["text"] for r in result.alerts.collect()}
    assert "size 42 EU (8.5 US)" in texts["alpha|v-aj1-8.5|42"]
    assert "no sizes" in texts["boxes|v-falcon"] and "sealed only" in texts["boxes|v-falcon"]
    stats = {r["retailer"]: r for r in result.stats.collect()}
    assert stats["alpha"]["candidates"] == 2 and stats["alpha"]["opportunities"] == 1
    assert stats["volts"]["opportunities"] == 0


def test_second_scan_is_silent(spark, result):
    config = _config()
    t = fixtures.tables(spark)
    state = result.alerts.select(
        "key", F.col("gate_profit").alias("last_profit"), F.col("in_stock").alias("was_in_stock")
    )
    inputs = ScanInputs(
        listing=t["listing"], policy=config.policy_frame(spark), catalog=t["catalog"], variants=t["variants"],
        quotes=t["quotes"], alert_state=state,
    )
    again = scan(inputs, config, F.lit(fixtures.NOW))
    assert again.opportunities.count() == 2
    assert again.alerts.count() == 0


def test_stored_scan_repeats_until_delivered(spark, tmp_path):
    from spreadlake.plans import jobs

    config = _config()
    store = jobs.Store(spark, str(tmp_path / "store"))
    t = fixtures.tables(spark)
    inputs = ScanInputs(
        listing=t["listing"], policy=config.policy_frame(spark), catalog=t["catalog"], variants=t["variants"], quotes=t["quotes"],
    )
    now = F.lit(fixtures.NOW)
    first = jobs.scan_job(store, inputs, config, now, scan_id="first")
    assert first.alerts.count() == 2
    # the listings are stored, and running the same scan again doubles nothing
    seen = store.listing.read().count()
    assert seen == t["listing"].select("retailer", "url").distinct().count()
    again = jobs.scan_job(store, inputs, config, now, scan_id="first")
    assert again.alerts.count() == 2 and store.log("alert_outbox", jobs.OUTBOX).count() == 2
    # it starts from where the first run started, so that all listings are new to it again
    forced = first.candidates.filter("forced").count()
    assert again.candidates.filter("forced").count() == forced > 0 and store.listing.read().count() == seen
    assert jobs.scan_job(store, inputs, config, now, scan_id="next").candidates.filter("forced").count() == 0
    cached = {r.cache_key: (r.found, r.product_id) for r in store.resolution.read().collect()}
    assert cached["75192"] == (True, "p-falcon") and len(cached) == 4
    assert {r.product_id for r in store.watch.read().collect()} >= {"p-aj1", "p-falcon"}
    # one of the two is delivered; the other comes again, matched from the cache,
    # while the first sold out in the meantime
    jobs.record_alerts(store, first.alerts.filter("retailer = 'boxes'").withColumn("payload", F.col("text")), now)
    gone = replace(inputs, listing=t["listing"].withColumn("in_stock", F.col("retailer") != "boxes"))
    second = jobs.scan_job(store, gone, config, now)
    assert [r.retailer for r in second.alerts.collect()] == ["alpha"] and second.resolution.count() == 0
    assert jobs.reviews(store).count() == 1
    jobs.record_alerts(store, second.alerts.withColumn("payload", F.col("text")), now)
    # back again: the state remembers that it was gone
    assert [(r.key, r.reason) for r in jobs.scan_job(store, inputs, config, now).alerts.collect()] == [("boxes|v-falcon", "restock")]
    log = store.log("scan_log", "started_at timestamp, retailer string, alerts_sent bigint")
    assert sorted(r.alerts_sent for r in log.filter("retailer = 'alpha'").collect()) == [0, 1, 1, 1]


def test_caps_of_the_configuration_hold_unless_lifted(spark):
    config = _config()
    config = replace(config, venue=replace(config.venue, calls_per_scan=0, resolutions_per_scan=1, gtin_lookups_per_scan=1))
    t = fixtures.tables(spark)
    listing = t["listing"].withColumn("ean", F.concat(F.lit("4006381"), F.format_string("%06d", F.col("ordinal"))))
    inputs = ScanInputs(
        listing=listing, policy=config.policy_frame(spark), catalog=t["catalog"], variants=t["variants"], quotes=t["quotes"],
        gtin_map=spark.createDataFrame([], "gtin string, found boolean, product_id string, variant_id string"),
    )
    none = scan(inputs, config, F.lit(fixtures.NOW))
    assert none.opportunities.count() == 0 and none.resolution.count() == 3
    per_shop = {r.retailer: r["count"] for r in none.barcodes.groupBy("retailer").count().collect()}
    assert per_shop and set(per_shop.values()) == {1}
    every = scan(inputs, config, F.lit(fixtures.NOW), backfill=True)
    assert every.opportunities.count() == 2 and every.barcodes.count() >= len(per_shop)


def test_a_page_that_was_read_is_what_is_stored(spark):
    from spreadlake.plans.scan import as_read

    listing = spark.createDataFrame([("s", "u", 10.0, True), ("s", "v", 20.0, True)], "retailer string, url string, price double, in_stock boolean")
    pages = spark.createDataFrame(
        [("s", "u", 11.0, False, fixtures.NOW), ("s", "v", 21.0, True, fixtures.NOW)], "retailer string, url string, price double, in_stock boolean, scraped_at timestamp")
    got = as_read(listing, listing.filter("url = 'u'"), pages)
    assert sorted(map(tuple, got.collect())) == [("s", "u", 11.0, False), ("s", "v", 20.0, True)]


def test_call_budget_and_caps(spark):
    config = _config()
    t = fixtures.tables(spark)
    inputs = ScanInputs(
        listing=t["listing"], policy=config.policy_frame(spark), catalog=t["catalog"], variants=t["variants"], quotes=t["quotes"],
    )
    # one lookup for each of the three shops
    none = scan(inputs, config, F.lit(fixtures.NOW), calls=0, resolutions=1)
    assert none.opportunities.count() == 0 and none.resolution.count() == 3 and none.watch.count() == 0
    assert scan(inputs, config, F.lit(fixtures.NOW), calls=0, resolutions=1, backfill=True).opportunities.count() == 2


def test_a_backfill_writes_its_listings_once(spark, monkeypatch):
    from spreadlake.plans import scan as plan

    config, written = _config(), []
    t = fixtures.tables(spark)
    inputs = ScanInputs(
        listing=t["listing"], policy=config.policy_frame(spark), catalog=t["catalog"], variants=t["variants"],
        quotes=t["quotes"],
    )
    keep = plan.materialize
    monkeypatch.setattr(plan, "materialize", lambda df: written.append(df.columns) or keep(df))
    every = plan.scan(inputs, config, F.lit(fixtures.NOW), backfill=True)
    assert sum("url" in names and "key" not in names for names in written) == 1
    assert {r["key"] for r in every.opportunities.collect()} == {"alpha|v-aj1-8.5|42", "boxes|v-falcon"}
    assert {r["product_id"] for r in every.watch.collect()} == {"p-aj1", "p-campus", "p-falcon", "p-ps5"}


def test_offers_are_those_of_the_view(spark, tmp_path):
    """Grouped as numbers: odd discounts and prices, lines and parts that come twice, no shop."""
    from spreadlake.checks import scan_checks, views as v

    nan = float("nan")
    parts = [(1, "a b", "Brand#1", "X", 100.0), (1, "a b", "Brand#1", "X", 100.0), (2, "c", "Brand#2", "Y", -50.0),
             (3, "d", "Brand#3", "Z", None), (4, None, None, None, 10.0), (4, "other", "Brand#4", "X", 20.0)]
    lines = [(p, s, n, d, "O" if o % 2 else "F", o) for o, (p, s, n, d) in enumerate([
        (1, 1, 1, 0.1), (1, 1, 1, 0.1), (1, 1, 2, nan), (1, 12, 2, 0.3), (1, 2, 1, nan), (2, 1, 1, 0.0), (2, 1, 3, 0.4),
        (2, 3, 3, None), (3, 1, 1, 0.2), (4, 5, 1, 0.2), (4, 5, None, 0.0), (1, None, 1, 0.9), (None, 1, 1, 0.9), (9, 1, 1, 0.0)])]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double").withColumn(
        "p_size", F.lit(1)).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(
        lines, "l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_linestatus string, l_orderkey long"
    ).withColumns({"l_tax": F.lit(0.0), "l_quantity": F.lit(1.0), "l_shipdate": F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(l_orderkey AS int))")}
                  ).write.parquet(f"{tmp_path}/lineitem.parquet")
    labels = v.listing(spark, str(tmp_path)).groupBy("retailer", "url", "size_label").agg(F.bool_or("in_stock").alias("s")).groupBy(
        "retailer", "url").agg(F.array_sort(F.collect_list(F.struct("size_label", "s"))).alias("sizes"))
    want = v.offer(spark, str(tmp_path)).drop("product_id", "style_code").join(labels, ["retailer", "url"])
    got = scan_checks.offers(spark, str(tmp_path))
    assert got.columns == [c for c in want.columns if c != "sizes"] + ["sizes"]

    def told(rows):
        return sorted(repr([[(s[0], s[-1]) for s in x] if isinstance(x, list) else x for x in r]) for r in rows.select(*got.columns).collect())

    assert told(got) == told(want) and got.count() > 6
    # sizes and offers come of one reading of the lines
    # lines are joined with parts once, not for offers and for sizes, and both together
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
