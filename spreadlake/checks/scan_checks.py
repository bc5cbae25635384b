"""A whole scan over the derived tables."""

from __future__ import annotations

import threading
from dataclasses import replace

from pyspark.sql import Window, functions as F

from spreadlake.checks import views as v
from spreadlake.checks.registry import query
from spreadlake.operators import opportunity
from spreadlake.plans import jobs
from spreadlake.plans.scan import ScanInputs, ScanResult, scan
from spreadlake.session import materialize, new_shared_path
from spreadlake.sources.landed import stream_table
from spreadlake.streaming.shops import Shop, Supervisor, scan_step

CODE = "concat(replace(p_brand, '#', ''), '-', lpad(p_partkey, 7, '0'))"


def offers(spark, sf):
    """The rows of `v.offer` that have a page, with their sizes. Lines are grouped as numbers, once
    for each shop, part and size; texts are made of what is left."""
    lines = v.table(spark, sf, "lineitem").selectExpr(
        "l_partkey AS part_id", "l_suppkey % 11 AS k", "l_linenumber", "l_discount", "l_linestatus = 'O' AS in_stock",
        "l_orderkey * 8 + l_linenumber AS ordinal", "cast(l_shipdate AS timestamp) AS seen_at",
    ).filter("k IS NOT NULL AND part_id IS NOT NULL")
    # a price falls or rises with the discount, so the lowest is at one of its ends; NaN is no end
    # unless there is nothing else
    number = F.when(~F.isnan("l_discount"), F.col("l_discount"))
    by_size = lines.groupBy("part_id", "k", "l_linenumber").agg(
        F.min(number).alias("low"), F.max(number).alias("high"), F.min("l_discount").alias("least"),
        F.max(F.col("l_discount") > 0).alias("on_sale"), F.bool_or("in_stock").alias("in_stock"),
        F.min("ordinal").alias("ordinal"), F.max("seen_at").alias("scraped_at"),
    )
    # a part has few rows by now, so that dealing by it alone serves the grouping and the join
    size = F.struct((37 + F.col("l_linenumber")).cast("string").alias("label"), F.col("in_stock").alias("s"))
    by_offer = by_size.repartition("part_id").groupBy("part_id", "k").agg(
        # seven labels at most
        F.array_sort(F.collect_list(size)).alias("sizes"),
        F.coalesce(F.min("low"), F.min("least")).alias("low"), F.coalesce(F.max("high"), F.min("least")).alias("high"),
        F.max("on_sale").alias("on_sale"), F.bool_or("in_stock").alias("in_stock"),
        F.min("ordinal").alias("ordinal"), F.max("scraped_at").alias("scraped_at"),
    )
    parts = v.part(spark, sf).selectExpr(
        "p_partkey AS part_id", "p_name AS name", "replace(p_brand, '#', ' ') AS brand", "replace(p_brand, '#', '') AS code_brand",
        "p_type AS category", "p_retailprice * 0.05D AS list_price").distinct().drop("code_brand")
    return by_offer.join(parts, "part_id").select(
        F.expr("concat('shop', k)").alias("retailer"),
        F.expr("concat('https://shop', k, '.example/p/', part_id)").alias("url"), "part_id", "name", "brand",
        F.expr("CASE WHEN part_id % 3 = 0 THEN concat('4006381', lpad(part_id, 6, '0')) END").alias("ean"),
        "category", "list_price",
        F.expr("least(list_price * (1 - low), list_price * (1 - high))").alias("price"), "on_sale", "in_stock", "ordinal",
        "scraped_at", F.lit("EUR").alias("currency"),
        F.transform("sizes", lambda x: F.struct(
            x["label"].alias("label"), F.lit("EU").alias("system"), F.lit(None).cast("string").alias("us_size"),
            F.lit(None).cast("string").alias("ean"), x["s"].alias("in_stock"))).alias("sizes"),
    )


def inputs(spark, sf) -> ScanInputs:
    """Every offer with its sizes, and a catalog in which every tenth part is
    known by name only."""
    listing = offers(spark, sf).withColumns(
        {
            "brand": F.replace("brand", F.lit(" "), F.lit("")),
            "style_code": F.concat(F.replace("brand", F.lit(" "), F.lit("")), F.lit("-"), F.lpad(F.col("part_id").cast("string"), 7, "0")),
            "price_verified": F.lit(True), "size_stock_unverified": F.lit(False), "stock_note": F.lit(None).cast("string"),
        }
    )
    catalog = v.part(spark, sf).selectExpr(
        "concat('p', p_partkey % 15) AS product_id",
        f"CASE WHEN p_partkey % 10 = 0 THEN concat('NONE-', p_partkey) ELSE {CODE} END AS style_id", "p_name AS title",
        "replace(p_brand, '#', '') AS brand", "cast(NULL AS string) AS url_key", "p_partkey AS ordinal",
    )
    market = v.market(spark, sf).drop("size")
    # a scan starts from tables; here Spark writes them first
    return ScanInputs(
        listing=materialize(listing), policy=v.config().policy_frame(spark), catalog=catalog, variants=materialize(v.variants(spark, sf)),
        quotes=materialize(market),
    )


def run(spark, sf) -> ScanResult:
    return scan(inputs(spark, sf), v.config(), v.now(), backfill=True)


_SIZED = f"""
    WITH size_row AS (SELECT retailer, url, size_label, bool_or(in_stock) AS stocked FROM listing GROUP BY ALL),
    cand AS (SELECT o.* FROM offer_costed o JOIN policy p USING (retailer) WHERE p.enabled AND o.in_stock AND o.price > 0 AND o.price <= 500),
    opp AS (SELECT c.retailer, c.url, c.retailer || '|' || variant_id || '|' || size_label AS key, discount_rank, ordinal, size_label,
                   {v.profit_sql('highest_bid', 'landed_cost')} AS gate_profit
            FROM cand c JOIN size_row s ON c.retailer = s.retailer AND c.url = s.url AND stocked
            JOIN market m ON m.product_id = c.product_id AND m.size = s.size_label
            WHERE part_id % 10 <> 0 AND num_bids >= 1 AND {v.profit_sql('highest_bid', 'landed_cost')} >= 0)
"""


@query("scan_opportunities", _SIZED + "SELECT retailer, url, key, gate_profit FROM opp", ("offer_costed", "market"))
def scan_opportunities(spark, sf):
    return run(spark, sf).opportunities.select("retailer", "url", "key", "gate_profit")


@query("scan_alerts", _SIZED + """
    , first AS (SELECT * FROM opp QUALIFY row_number() OVER (PARTITION BY key ORDER BY discount_rank DESC, ordinal, size_label) = 1)
    SELECT key, url, gate_profit FROM first QUALIFY row_number() OVER (PARTITION BY retailer ORDER BY discount_rank DESC, ordinal, size_label, key) <= 20
""", ("offer_costed", "market"))
def scan_alerts(spark, sf):
    """The first alerts of each shop in scan order."""
    return run(spark, sf).alerts.select("key", "url", "gate_profit")


@query("scan_reviews", _SIZED + """
    SELECT retailer, url, 'low_match_confidence' AS reason FROM cand WHERE part_id % 10 = 0
""", ("offer_costed", "market"))
def scan_reviews(spark, sf):
    """Offers that only a name matched go to a person."""
    return run(spark, sf).reviews.select("retailer", "url", "reason")


@query("scan_statistics", _SIZED + """
    SELECT l.retailer, count(*) AS products_seen, coalesce(any_value(c.n), 0) AS candidates, coalesce(any_value(o.n), 0) AS opportunities, least(coalesce(any_value(o.keys), 0), 20) AS alerts_sent
    FROM offer l LEFT JOIN (SELECT retailer, count(*) AS n FROM cand GROUP BY 1) c USING (retailer) LEFT JOIN (SELECT retailer, count(*) AS n, count(DISTINCT key) AS keys FROM opp GROUP BY 1) o USING (retailer)
    GROUP BY l.retailer
""", ("offer_costed", "market"))
def scan_statistics(spark, sf):
    return run(spark, sf).stats


@query("stored_scan", _SIZED + f"""
    , f AS (SELECT * FROM opp QUALIFY row_number() OVER (PARTITION BY key ORDER BY discount_rank DESC, ordinal, size_label) = 1),
    one AS (SELECT *, row_number() OVER (PARTITION BY retailer ORDER BY discount_rank DESC, ordinal, size_label, key) AS rn FROM f QUALIFY rn <= 20),
    sent AS (SELECT key, gate_profit AS told FROM one WHERE rn % 2 = 0),
    due AS (SELECT opp.* FROM opp LEFT JOIN sent USING (key) WHERE told IS NULL OR abs(gate_profit - told) >= {v.config().alerts.re_alert_delta}),
    g AS (SELECT * FROM due QUALIFY row_number() OVER (PARTITION BY key ORDER BY discount_rank DESC, ordinal, size_label) = 1),
    two AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY retailer ORDER BY discount_rank DESC, ordinal, size_label, key) <= 20)
    SELECT 'one' AS scan_id, key, url, gate_profit FROM one UNION ALL SELECT 'two', key, url, gate_profit FROM two
""", ("offer_costed", "market"))
def stored_scan(spark, sf):
    """The outbox after two stored scans, with every second alert of the first delivered. The
    second one is run twice, and must leave what it left at first."""
    store = jobs.Store(spark, new_shared_path(spark, "store"))
    given = inputs(spark, sf)
    first = jobs.scan_job(store, given, v.config(), v.now(), scan_id="one", backfill=True)
    turn = Window.partitionBy("retailer").orderBy(*opportunity.report_order(first.alerts))
    delivered = first.alerts.withColumn("rn", F.row_number().over(turn)).filter("rn % 2 = 0")
    jobs.record_alerts(store, delivered.withColumn("payload", F.col("text")), v.now())
    for _ in range(2):
        jobs.scan_job(store, given, v.config(), v.now(), scan_id="two", backfill=True)
    return store.log("alert_outbox", jobs.OUTBOX).select("scan_id", "key", "url", "gate_profit")


@query("shop_scans_stream", _SIZED + """
    , f AS (SELECT * FROM opp QUALIFY row_number() OVER (PARTITION BY key ORDER BY discount_rank DESC, ordinal, size_label) = 1),
    one AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY retailer ORDER BY discount_rank DESC, ordinal, size_label, key) <= 20)
    SELECT CASE WHEN CAST(substr(retailer, 5) AS INTEGER) % 2 = 0 THEN 'even-0' ELSE 'odd-0' END AS scan_id, key, url, gate_profit FROM one
""", ("offer_costed", "market"))
def shop_scans_stream(spark, sf):
    """Scans of two streams of shops over one store. One of them fails at first, after its
    alerts were stored, and is started again; the other goes on."""
    store = jobs.Store(spark, new_shared_path(spark, "shops"))
    given, turn = inputs(spark, sf), threading.Lock()
    prepared = replace(given, catalog=materialize(given.catalog))
    broken = {"odd"}

    def step(name):
        scan_batch = scan_step(store, prepared, v.config(), name, v.now(), turn, backfill=True)

        def run(batch, batch_id):
            scan_batch(batch, batch_id)
            if name in broken:
                broken.discard(name)
                raise RuntimeError("a shop that fails once")

        return run

    shops = {}
    for name, rest in (("even", 0), ("odd", 1)):
        folder = f"{store.root}/landed/{name}"
        own = given.listing.filter(F.substring("retailer", 5, 9).cast("int") % 2 == rest)
        own.write.parquet(folder)
        shops[name] = Shop(stream_table(spark, folder, own.schema), step(name))
    watched = Supervisor(spark, shops, store.root, first=0.1).start()
    try:
        if not watched.await_end(1800):
            raise RuntimeError(f"scans that do not end: {watched.errors}")
    finally:
        watched.stop()
    return store.log("alert_outbox", jobs.OUTBOX).select("scan_id", "key", "url", "gate_profit")
