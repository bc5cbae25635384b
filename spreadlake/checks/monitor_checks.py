"""Monitoring figures, run history, sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from spreadlake.checks import views as v
from spreadlake.checks.money_checks import _OPP, costed, opportunities
from spreadlake.checks.registry import query
from spreadlake.checks.state_checks import scan_rows, store
from spreadlake.operators import monitor, sales, screen
from spreadlake.operators.ordered import rolling_count
from spreadlake.plans import jobs

END = "timestamp'2001-08-02 00:00:00'"
END_SQL = "TIMESTAMP '2001-08-02 00:00:00'"


def _end():
    return F.expr(END)


@query("coverage_stats", """
    WITH o AS (SELECT count(*) AS retail_products, count(*) FILTER (in_stock) AS in_stock, count(DISTINCT style_code) AS distinct_style_codes FROM offer),
    r AS (SELECT count(*) AS checked, count(*) FILTER (p_partkey % 3 <> 0) AS matched, count(*) FILTER (p_partkey % 3 = 0) AS unmatched FROM part WHERE p_partkey % 2 = 0)
    SELECT *, greatest(distinct_style_codes - checked, 0) AS pending,
           CASE WHEN distinct_style_codes <> 0 THEN round(100.0::DOUBLE * checked / distinct_style_codes, 1) ELSE 0 END AS percent FROM o, r
""", ("offer",))
def coverage_stats(spark, sf):
    resolution = v.part(spark, sf).filter("p_partkey % 2 = 0").selectExpr("p_partkey % 3 <> 0 AS found")
    return monitor.coverage(v.offer(spark, sf), resolution)


@query("market_health", f"""
    WITH r AS (SELECT ratio, row_number() OVER (ORDER BY ratio) AS i, count(*) OVER () AS n
               FROM (SELECT highest_bid / lowest_ask AS ratio FROM market WHERE highest_bid <> 0 AND lowest_ask <> 0))
    SELECT count(*) AS variant_snapshots, count(*) FILTER (fetched_at >= {v.NOW_SQL} - INTERVAL 720 MINUTES) AS fresh,
           count(*) FILTER (highest_bid <> 0) AS with_live_bid,
           (SELECT (min(ratio) + max(ratio)) / 2 FROM r WHERE i IN ((n + 1) // 2, n // 2 + 1)) AS median_bid_ask,
           round(100.0::DOUBLE * count(*) FILTER (highest_bid <> 0) / count(*), 1) AS with_live_bid_pct FROM market
""", ("market",))
def market_health(spark, sf):
    return monitor.market_health(v.market(spark, sf), v.now(), 720)


@query("gtin_hit_rate", """
    SELECT count(*) AS looked_up, count(*) FILTER (p_partkey % 4 <> 0) AS matched,
           round(100.0::DOUBLE * count(*) FILTER (p_partkey % 4 <> 0) / count(*), 1) AS hit_rate FROM part
""")
def gtin_hit_rate(spark, sf):
    return monitor.gtin_hit_rate(v.part(spark, sf).selectExpr("p_partkey % 4 <> 0 AS found"))


@query("budget_use", f"""
    SELECT count(*) AS used_24h, 23500 AS budget, round(100.0::DOUBLE * count(*) / 23500, 1) AS percent
    FROM events WHERE ts >= {v.NOW_SQL} - INTERVAL 24 HOURS
""")
def budget_use(spark, sf):
    return monitor.budget_use(v.events(spark, sf), v.now(), v.config().venue.daily_request_budget)


@query("pruned_requests", f"SELECT event_id FROM events WHERE ts >= {v.NOW_SQL} - INTERVAL 24 HOURS")
def pruned_requests(spark, sf):
    return monitor.pruned_requests(v.events(spark, sf), v.now()).select("event_id")


@query("rolling_24h", """
    SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS used_24h FROM events
""")
def rolling_24h(spark, sf):
    """Requests in the 24 hours up to every request."""
    return rolling_count(v.events(spark, sf).select("event_id", "ts"), "ts", 86400, "used_24h").select(
        "event_id", "used_24h"
    )


@query("alert_totals", f"""
    SELECT count(*) AS total, count(*) FILTER (ts >= {v.NOW_SQL} - INTERVAL 24 HOURS) AS last_24h FROM events
""")
def alert_totals(spark, sf):
    state = v.events(spark, sf).select(F.col("ts").alias("last_alerted"))
    return monitor.alert_totals(state, v.now())


@query("top_alerts", """
    SELECT 'k' || event_id AS key, value AS last_profit FROM events ORDER BY value DESC, key LIMIT 15
""")
def top_alerts(spark, sf):
    state = v.events(spark, sf).select(
        F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), F.col("value").alias("last_profit")
    )
    return monitor.top_alerts(state)


@query("status_summary", """
    SELECT 'retail_products' AS item, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey % 11 FROM lineitem)
    UNION ALL SELECT 'codes_resolved', count(*) FROM part WHERE p_partkey % 4 <> 1
    UNION ALL SELECT 'codes_unmatched', count(*) FROM part WHERE p_partkey % 4 = 1
    UNION ALL SELECT 'market_snapshots', count(DISTINCT user_id) FROM events WHERE event_type <> 'error'
    UNION ALL SELECT 'alerts', 0 UNION ALL SELECT 'open_reviews', count(DISTINCT user_id) FROM events WHERE event_type = 'error'
""")
def status_summary(spark, sf):
    from spreadlake.checks.state_checks import _resolution_rows

    s = store(spark)
    jobs.put_resolution(s, _resolution_rows(spark, sf, 1, "true"))
    entries = v.events(spark, sf).filter("event_type = 'error'").selectExpr(
        "ts AS created_at", "'shop1' AS retailer", "concat('https://x/', user_id) AS url", "'AB-1' AS style_code",
        "'other' AS reason", "'{}' AS detail",
    )
    jobs.add_reviews(s, entries)
    return jobs.status(s, v.offer(spark, sf), v.market(spark, sf))


@query("scan_stats", f"""
    WITH c AS (SELECT retailer, count(*) AS n FROM costed WHERE in_stock AND (style_code IS NOT NULL OR ean IS NOT NULL) AND price > 0 AND price <= 500 AND currency = 'EUR' GROUP BY 1),
    o AS (SELECT retailer, count(*) AS n {_OPP} GROUP BY 1)
    SELECT l.retailer, l.n AS products_seen, coalesce(c.n, 0) AS candidates, coalesce(o.n, 0) AS opportunities, least(coalesce(o.n, 0), 20) AS alerts_sent
    FROM (SELECT retailer, count(*) AS n FROM listing GROUP BY 1) l LEFT JOIN c USING (retailer) LEFT JOIN o USING (retailer)
""", ("costed", "market"))
def scan_stats(spark, sf):
    from spreadlake.operators import alerts

    cands = screen.cheap_screen(costed(spark, sf), v.config().filters)
    opps = opportunities(spark, sf)
    sent = alerts.cap(opps, 20, [F.asc("ordinal"), F.asc("key"), F.asc("price")])
    return monitor.scan_stats(v.listing(spark, sf), cands, opps, sent)


def _runs(spark, sf):
    """Orders as scan runs of a shop per day; status F is a failure."""
    return v.table(spark, sf, "orders").selectExpr(
        "concat('shop', o_custkey % 11) AS retailer", "cast(o_orderdate AS timestamp) AS at", "o_orderkey",
        "o_orderstatus <> 'F' AS ok",
    )


@query("failure_streaks", """
    WITH r AS (SELECT 'shop' || (o_custkey % 11) AS retailer, o_orderdate AS done, o_orderkey, o_orderstatus <> 'F' AS ok FROM orders),
    n AS (SELECT *, row_number() OVER w AS n, sum(ok::INT) OVER w AS island FROM r WINDOW w AS (PARTITION BY retailer ORDER BY done, o_orderkey))
    SELECT o_orderkey, CASE WHEN ok THEN 0 ELSE row_number() OVER (PARTITION BY retailer, island, ok ORDER BY n) END AS failures_in_row FROM n
""")
def failure_streaks(spark, sf):
    return monitor.failure_streaks(_runs(spark, sf), [F.col("at"), F.col("o_orderkey")]).select(
        "o_orderkey", "failures_in_row"
    )


@query("current_failures", """
    WITH r AS (SELECT 'shop' || (o_custkey % 11) AS retailer, o_orderdate AS done, o_orderstatus <> 'F' AS ok FROM orders),
    l AS (SELECT retailer, max(done) AS last_ok FROM r WHERE ok GROUP BY 1)
    SELECT retailer, count(*) FILTER (NOT ok AND (last_ok IS NULL OR done > last_ok)) AS failures FROM r LEFT JOIN l USING (retailer) GROUP BY 1
""")
def current_failures(spark, sf):
    return monitor.current_failures(_runs(spark, sf), "at")


@query("latest_scan", f"""
    WITH s AS (SELECT 'shop' || (o_custkey % 11) AS retailer, max(o_orderdate) AS started_at, max_by(o_orderkey % 100, o_orderdate) AS candidates FROM orders GROUP BY 1)
    SELECT p.retailer, epoch_us(started_at) AS at_us, date_diff('second', started_at, {END_SQL})::DOUBLE AS age_seconds,
           enabled AND date_diff('second', started_at, {END_SQL}) > scan_interval_minutes * 120 AS overdue
    FROM policy p LEFT JOIN s USING (retailer)
""", ("policy",))
def latest_scan(spark, sf):
    out = monitor.latest_scan(scan_rows(spark, sf), v.config().policy_frame(spark), _end())
    return out.select("retailer", F.unix_micros("started_at").alias("at_us"), "age_seconds", "overdue")


def _start_finish(spark, sf):
    return v.table(spark, sf, "orders").selectExpr(
        "concat('c', o_custkey) AS retailer", "CASE WHEN o_orderkey % 3 = 0 THEN 'finish' ELSE 'start' END AS event",
        "cast(o_orderdate AS timestamp) AS at",
    )


@query("inflight", """
    WITH e AS (SELECT 'c' || o_custkey AS retailer, max(o_orderdate) FILTER (o_orderkey % 3 <> 0) AS s, max(o_orderdate) FILTER (o_orderkey % 3 = 0) AS f FROM orders GROUP BY 1)
    SELECT retailer, coalesce(s IS NOT NULL AND (f IS NULL OR s > f), false) AS scanning FROM e
""")
def inflight(spark, sf):
    return monitor.in_flight(_start_finish(spark, sf)).select("retailer", "scanning")


@query("shop_status", f"""
    WITH e AS (SELECT 'shop' || (o_custkey % 11) AS retailer, max(o_orderdate) FILTER (o_orderkey % 2 = 0) AS s, max(o_orderdate) FILTER (o_orderkey % 2 = 1) AS f,
                      max(o_orderdate) AS started_at FROM orders GROUP BY 1)
    SELECT retailer, enabled, coalesce(s > f, false) AS scanning,
           coalesce(enabled AND NOT coalesce(s > f, false) AND date_diff('second', started_at, {END_SQL}) > scan_interval_minutes * 120, false) AS overdue
    FROM policy LEFT JOIN e USING (retailer) ORDER BY NOT enabled, retailer
""", ("policy",))
def shop_status(spark, sf):
    """Status per shop, enabled ones first."""
    runs = v.table(spark, sf, "orders").selectExpr(
        "concat('shop', o_custkey % 11) AS retailer", "CASE WHEN o_orderkey % 2 = 0 THEN 'start' ELSE 'finish' END AS event",
        "cast(o_orderdate AS timestamp) AS at",
    )
    status = monitor.latest_scan(
        scan_rows(spark, sf), v.config().policy_frame(spark), _end(), monitor.in_flight(runs)
    )
    return monitor.shop_order(status).select("retailer", "enabled", "scanning", "overdue")


@query("heartbeat", f"""
    SELECT epoch_us(max(o_orderdate)) AS beat_us, 1800 AS stale_after_s, date_diff('second', max(o_orderdate), {END_SQL}) < 1800 AS up FROM orders
""")
def heartbeat(spark, sf):
    """Up while the last finished scan is younger than the limit."""
    finished = v.table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"))
    return monitor.heartbeat(finished, v.config().policy_frame(spark), _end()).select(
        F.unix_micros("last_beat").alias("beat_us"), "stale_after_s", "up"
    )


# -- sales -------------------------------------------------------------------------------

def _sales(spark, sf):
    """Orders as completed sales; every fifth without a recorded bid."""
    return v.table(spark, sf, "orders").selectExpr(
        "cast(o_orderdate AS timestamp) AS sold_at", "concat('shop', o_custkey % 11) AS retailer",
        "cast(o_orderkey AS string) AS style_code", "'t' AS title", "'42' AS size_label", "concat('v', o_custkey) AS variant_id",
        "o_totalprice / 1000.0D AS paid_eur", "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 700.0D END AS bid_eur",
        "o_totalprice / 900.0D AS payout_eur", "'' AS note",
    )


_SALES = f"""
    WITH s AS (SELECT o_orderkey, o_totalprice / 1000.0::DOUBLE AS paid, o_totalprice / 900.0::DOUBLE AS payout,
                      CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 700.0::DOUBLE END AS bid FROM orders),
    p AS (SELECT *, CASE WHEN bid > 0 THEN {v.payout_sql('bid')} END AS predicted FROM s)
"""


@query("sale_outcomes", _SALES + """
    SELECT CAST(o_orderkey AS VARCHAR) AS style_code, payout - paid AS profit, (payout - paid) / paid * 100 AS profit_pct,
           payout - predicted AS model_gap,
           CASE WHEN payout < predicted THEN 'model OPTIMISTIC' WHEN payout > predicted THEN 'model conservative' END AS verdict FROM p
""")
def sale_outcomes(spark, sf):
    s = store(spark)
    jobs.record_sales(s, _sales(spark, sf), v.config())
    outcomes, _ = jobs.sold_report(s)
    return outcomes.select("style_code", "profit", "profit_pct", "model_gap", "verdict")


@query("calibration", _SALES + """
    SELECT count(predicted) AS n, round(avg(payout - predicted), 6) AS mean_gap FROM p
""")
def calibration(spark, sf):
    return sales.calibration(sales.with_prediction(_sales(spark, sf), v.config())).withColumn("mean_gap", F.round("mean_gap", 6))


@query("sales_by_date", """
    SELECT CAST(o_orderkey AS VARCHAR) AS style_code, epoch_us(o_orderdate) AS sold_us FROM orders ORDER BY o_orderdate
""")
def sales_by_date(spark, sf):
    return sales.by_date(_sales(spark, sf)).select("style_code", F.unix_micros("sold_at").alias("sold_us"))
