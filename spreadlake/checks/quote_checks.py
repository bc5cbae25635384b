"""Quotes: latest, as-of, freshness, cadence, budget."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from spreadlake.checks import views as v
from spreadlake.checks.money_checks import costed_offers
from spreadlake.checks.registry import query
from spreadlake.functions import times
from spreadlake.operators import quotes, state
from spreadlake.operators.ordered import top_n_per_group


@query("quote_latest", """
    SELECT variant_id, epoch_us(max(fetched_at)) AS fetched_us,
           max_by(event_id, fetched_at) AS event_id FROM quote_history GROUP BY variant_id
""", ("quote_history",))
def quote_latest(spark, sf):
    out = quotes.latest(v.quote_history(spark, sf))
    return out.select("variant_id", F.unix_micros("fetched_at").alias("fetched_us"), "event_id")


@query("quote_asof", """
    WITH probe AS (SELECT event_id AS probe_id, 'v' || user_id AS variant_id, ts AS asked_at FROM events WHERE event_type = 'error')
    SELECT probe_id, q.event_id, epoch_us(q.fetched_at) AS quote_us
    FROM probe ASOF LEFT JOIN quote_history q ON probe.variant_id = q.variant_id AND probe.asked_at >= q.fetched_at
""", ("quote_history",))
def quote_asof(spark, sf):
    """The quote known at each error event, on one time line per variant."""
    probes = v.events(spark, sf).filter("event_type = 'error'").selectExpr(
        "event_id AS probe_id", "concat('v', user_id) AS variant_id", "ts AS asked_at"
    )
    out = quotes.as_of(probes, v.quote_history(spark, sf), "asked_at", ["event_id"])
    return out.select("probe_id", "event_id", F.unix_micros("quote_at").alias("quote_us"))


@query("quote_fresh_ttl", f"""
    SELECT product_id, count(*) AS n_variants, count(*) FILTER (fresh) AS n_fresh, bool_and(fresh) AS all_fresh
    FROM (SELECT v.product_id, coalesce(fetched_at >= {v.NOW_SQL} - to_minutes(720 + 30 * CAST(substr(v.product_id, 2) AS INT)), false) AS fresh
          FROM variant v LEFT JOIN market m USING (variant_id))
    GROUP BY product_id
""", ("variant", "market"))
def quote_fresh_ttl(spark, sf):
    variants = v.variants(spark, sf)
    ttl = variants.select("product_id").distinct().withColumn(
        "ttl_minutes", F.lit(720) + F.lit(30) * F.substring("product_id", 2, 10).cast("int")
    )
    return quotes.freshness(variants, v.market(spark, sf), ttl, v.now())


@query("quote_ages", f"""
    SELECT event_id, epoch_us({v.NOW_SQL}) / 1000000.0::DOUBLE - epoch_us(ts) / 1000000.0::DOUBLE AS age_seconds,
           ts >= {v.NOW_SQL} - INTERVAL 720 MINUTES AS fresh FROM events
""")
def quote_ages(spark, sf):
    read = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    at = times.iso_time(read)
    return v.events(spark, sf).select(
        "event_id", times.age_seconds(at, v.now()).alias("age_seconds"),
        times.is_fresh(at, v.now(), F.lit(720)).alias("fresh"),
    )


@query("watch_deadlines", """
    SELECT o_orderkey, epoch_us(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 86399 SECONDS ELSE o_orderdate + INTERVAL 3 HOURS END) AS until_us
    FROM orders
""")
def watch_deadlines(spark, sf):
    at = F.col("o_orderdate").cast("timestamp")
    given = F.when(F.col("o_orderkey") % 2 == 0, at).otherwise(at + F.expr("INTERVAL 3 HOURS"))
    return v.table(spark, sf, "orders").select("o_orderkey", F.unix_micros(times.deadline(given)).alias("until_us"))


def _watch(spark, sf):
    """Best profit per part at its last look: some never looked at, some without
    any bid."""
    return v.part(spark, sf).filter("p_partkey % 4 <> 0").selectExpr(
        "concat('c', p_partkey) AS product_id",
        "CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE cast(p_size - 90 + p_partkey % 100 AS double) END AS best_profit",
    )


@query("ttl_tier", """
    SELECT 'c' || p_partkey AS product_id, CASE WHEN p_partkey % 4 = 0 THEN 45 WHEN p_partkey % 4 = 1 THEN 720
      WHEN p_size - 90 + p_partkey % 100 >= 0 THEN 45 WHEN p_size - 90 + p_partkey % 100 >= -60 THEN 180 ELSE 720 END AS ttl_minutes
    FROM part
""")
def ttl_tier(spark, sf):
    rows = v.part(spark, sf).selectExpr("concat('c', p_partkey) AS product_id")
    return quotes.with_ttl(rows, _watch(spark, sf), v.config())


@query("refresh_due", f"""
    WITH w AS (SELECT product_id, CASE CAST(substr(product_id, 2) AS INT) % 4 WHEN 0 THEN 45 WHEN 1 THEN 720 WHEN 2 THEN 45 ELSE 180 END AS ttl_minutes FROM (SELECT DISTINCT product_id FROM variant))
    SELECT w.product_id, w.ttl_minutes, count(*) AS n_variants, count(*) FILTER (coalesce(fetched_at >= {v.NOW_SQL} - to_minutes(ttl_minutes), false)) AS n_fresh
    FROM w JOIN variant x USING (product_id) LEFT JOIN market m ON x.variant_id = m.variant_id GROUP BY ALL HAVING n_fresh < n_variants
""", ("variant", "market"))
def refresh_due(spark, sf):
    """Products whose quotes are older than their tier allows."""
    variants = v.variants(spark, sf)
    n = F.substring("product_id", 2, 10).cast("int") % 4
    watch = variants.select("product_id").distinct().filter(n != 0).withColumn(
        "best_profit", F.when(n == 2, 5.0).when(n == 3, -30.0)
    )
    out = quotes.refresh_due(variants, v.market(spark, sf), watch, v.now(), v.config())
    return out.select("product_id", "ttl_minutes", "n_variants", "n_fresh")


@query("budget_cut", """
    WITH n AS (SELECT *, part_id % 3 = 0 AS needs, part_id % 5 <> 0 AS stale FROM offer_costed),
    t AS (SELECT *, row_number() OVER (PARTITION BY retailer, product_id ORDER BY discount_rank DESC, ordinal, url) AS turn FROM n WHERE needs OR stale),
    c AS (SELECT *, row_number() OVER (PARTITION BY retailer ORDER BY discount_rank DESC, ordinal, url) AS rn FROM t WHERE needs OR turn = 1)
    SELECT retailer, url, needs FROM n WHERE NOT needs AND NOT stale
    UNION ALL SELECT retailer, url, needs FROM c WHERE rn <= 20
    UNION ALL SELECT retailer, url, needs FROM t WHERE NOT needs AND turn > 1
      AND EXISTS (SELECT 1 FROM c WHERE c.rn <= 20 AND c.retailer = t.retailer AND c.product_id = t.product_id)
""", ("offer_costed",))
def budget_cut(spark, sf):
    """Offers the quote budget still reaches, deepest discount first; stale quotes of a
    product are paid for once in a shop."""
    rows = costed_offers(spark, sf).withColumn("needs", F.col("part_id") % 3 == 0)
    order = [F.desc("discount_rank"), F.asc("ordinal"), F.asc("url")]
    return quotes.within_budget(rows, F.col("needs"), order, 20, F.col("part_id") % 5 != 0).select("retailer", "url", "needs")


@query("resolution_cap", """
    WITH n AS (SELECT DISTINCT retailer, style_code FROM listing WHERE style_code IS NOT NULL)
    SELECT retailer, style_code, row_number() OVER (PARTITION BY retailer ORDER BY style_code) AS turn FROM n
    QUALIFY turn <= 40
""", ("listing",))
def resolution_cap(spark, sf):
    """New lookups per shop and scan."""
    need = v.listing(spark, sf).filter("style_code IS NOT NULL").select("retailer", "style_code").distinct()
    return top_n_per_group(need, ["retailer"], [F.asc("style_code")], 40, rank="turn")


@query("variants_of_product", """
    SELECT retailer, url, count(*) AS variants, min(size) AS smallest FROM offer JOIN variant USING (product_id) GROUP BY ALL
""", ("offer", "variant"))
def variants_of_product(spark, sf):
    """Variants behind each offer, counted per product before the join."""
    per = v.variants(spark, sf).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("variants"), F.min("size").alias("smallest")
    )
    return v.offer(spark, sf).join(per, "product_id").select("retailer", "url", "variants", "smallest")


@query("changed_force", """
    WITH o AS (SELECT retailer, url, min(price) AS price, bool_or(in_stock) AS s FROM listing WHERE seen_at < TIMESTAMP '1998-01-01' GROUP BY ALL),
    n AS (SELECT retailer, url, min(price) AS price, bool_or(in_stock) AS s FROM listing WHERE seen_at >= TIMESTAMP '1998-01-01' GROUP BY ALL)
    SELECT n.retailer, n.url FROM n LEFT JOIN o ON n.retailer = o.retailer AND n.url = o.url
    WHERE o.url IS NULL OR n.price < o.price - 0.01::DOUBLE OR (NOT o.s AND n.s)
""", ("listing",))
def changed_force(spark, sf):
    """Listings whose quotes must be read anew."""
    return state.changed_keys(state.listing_changes(*snapshots(spark, sf)))


def snapshots(spark, sf):
    """(new, old) sightings of each (shop, url)."""

    def snap(condition):
        return v.listing(spark, sf).filter(condition).groupBy("retailer", "url", "name", "style_code").agg(
            F.min("price").alias("price"), F.bool_or("in_stock").alias("in_stock"), F.min("seen_at").alias("first_seen"),
            F.max("seen_at").alias("last_seen"),
        )

    cut = "seen_at {} timestamp'1998-01-01 00:00:00'"
    return snap(cut.format(">=")), snap(cut.format("<"))
