"""Alert decisions, caps, re-checks, sibling notes, collapse, watching."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from spreadlake.checks import views as v
from spreadlake.checks.money_checks import _OPP, costed_offers, opportunities
from spreadlake.checks.registry import query
from spreadlake.operators import alerts, opportunity, report, screen, watch
from spreadlake.operators.ordered import top_n_per_group
from spreadlake.operators.skew import dealt_by, sent_if_small
from spreadlake.session import materialize


def _keyed_opportunities(spark, sf):
    """Best opportunity per alert key, so that a key stands for one alert."""
    rows = opportunities(spark, sf)
    return rows.groupBy("key").agg(
        F.max("gate_profit").alias("gate_profit"), F.min("retailer").alias("retailer"),
        F.min("ordinal").alias("ordinal"), F.bool_and("in_stock").alias("in_stock"),
    )


_KEYED = f"""
    WITH k AS (SELECT retailer || '|' || variant_id || '|' || c.size_label AS key, min(retailer) AS retailer,
                      max({v.profit_sql('highest_bid', 'landed_cost')}) AS gate_profit, min(ordinal) AS ordinal,
                      min(CAST(substr(variant_id, 2) AS INT)) AS u {_OPP} GROUP BY 1)
"""


def _alert_state(rows):
    """What was alerted before: a third unknown, a third sold out since, the
    rest at figures close to or far from today's."""
    u = F.regexp_extract("key", r"\|v([0-9]+)", 1).cast("int")
    return rows.filter(u % 3 != 0).select(
        "key", F.lit(v.NOW).alias("first_alerted"), F.lit(v.NOW).alias("last_alerted"),
        (F.col("gate_profit") - F.when(u % 2 == 0, 4.0).otherwise(10.0)).alias("last_profit"),
        (u % 3 != 1).alias("was_in_stock"), F.lit("old").alias("payload"),
    )


_DUE = _KEYED + f""",
    o AS (SELECT retailer || '|' || variant_id || '|' || c.size_label AS key, retailer, ordinal,
                 CAST(substr(variant_id, 2) AS INT) AS u, {v.profit_sql('highest_bid', 'landed_cost')} AS g {_OPP}),
    r AS (SELECT o.key, o.retailer, o.ordinal, g,
                 CASE WHEN o.u % 3 = 0 THEN 'new' WHEN o.u % 3 = 1 THEN 'restock'
                      WHEN abs(g - (gate_profit - CASE WHEN o.u % 2 = 0 THEN 4.0 ELSE 10.0 END::DOUBLE)) >= 10 THEN 'profit_change'
                      ELSE 'duplicate' END AS reason FROM o JOIN k USING (key)),
    d AS (SELECT * FROM r WHERE reason <> 'duplicate' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ordinal, g DESC) = 1)
"""


def _due(spark, sf):
    """Every opportunity judged, repeated keys included, and the first due one of each."""
    state = _alert_state(_keyed_opportunities(spark, sf))
    rows = alerts.due(opportunities(spark, sf), state, 10.0)
    return alerts.first_per_key(rows, [F.asc("ordinal"), F.desc("gate_profit")])


@query("alert_dedup", _DUE + "SELECT key, reason FROM d", ("costed", "market"))
def alert_dedup(spark, sf):
    return _due(spark, sf).select("key", "reason")


@query("alert_cap", _DUE + """
    SELECT key, reason FROM d QUALIFY row_number() OVER (PARTITION BY retailer ORDER BY ordinal, key) <= 5
""", ("costed", "market"))
def alert_cap(spark, sf):
    """First due alerts of each shop; the others come back next time."""
    return alerts.cap(_due(spark, sf), 5, [F.asc("ordinal"), F.asc("key")]).select("key", "reason")


@query("alert_record", _KEYED + f"""
    SELECT key, CASE WHEN u % 5 = 0 THEN gate_profit ELSE gate_profit - CASE WHEN u % 2 = 0 THEN 4.0 ELSE 10.0 END::DOUBLE END AS last_profit,
           CASE WHEN u % 5 = 0 THEN 'now' ELSE 'old' END AS payload,
           CASE WHEN u % 7 = 0 THEN false WHEN u % 5 = 0 THEN true ELSE u % 3 <> 1 END AS was_in_stock,
           u % 3 <> 0 AS known_before
    FROM k WHERE u % 3 <> 0 OR u % 5 = 0
""", ("costed", "market"))
def alert_record(spark, sf):
    """State after delivery receipts and stock losses."""
    rows = _keyed_opportunities(spark, sf)
    u = F.regexp_extract("key", r"\|v([0-9]+)", 1).cast("int")
    later = F.lit(v.NOW) + F.expr("INTERVAL 1 DAY")
    delivered = rows.filter(u % 5 == 0).withColumn("payload", F.lit("now"))
    state = alerts.record(_alert_state(rows), delivered, later)
    gone = alerts.mark_out_of_stock(state, rows.filter(u % 7 == 0))
    return gone.select(
        "key", "last_profit", "payload", "was_in_stock", (F.col("first_alerted") < later).alias("known_before")
    )


@query("unverified_collapse", f"""
    WITH o AS (SELECT retailer, url, c.product_id, variant_id, l_orderkey, l_linenumber, part_id, ordinal, c.size_label,
                      {v.profit_sql('highest_bid', 'landed_cost')} AS g {_OPP})
    SELECT retailer || '|' || product_id || '|unverified' AS key, url, count(*) AS sizes, max(g) AS best FROM o WHERE part_id % 2 = 0 GROUP BY ALL
    UNION ALL
    SELECT retailer || '|' || variant_id || '|' || size_label, url, count(*) OVER (PARTITION BY url), g FROM o WHERE part_id % 2 = 1
""", ("costed", "market"))
def unverified_collapse(spark, sf):
    """One product-level opportunity per listing whose sizes are unverified; the others stay."""
    rows = opportunities(spark, sf).withColumns(
        {"size_stock_unverified": F.col("part_id") % 2 == 0, "score": F.col("gate_profit"), "size_pos": F.col("ordinal")}
    )
    sizes = rows.groupBy("url").agg(F.count(F.lit(1)).alias("sizes"))
    return opportunity.collapse_unverified(rows).join(sizes, "url").select(
        "key", "url", "sizes", F.col("gate_profit").alias("best")
    )


def _detail(spark, sf):
    """Page reads of two thirds of the offers: dearer, sold out or unchanged."""
    return v.offer(spark, sf).filter("part_id % 3 <> 0").selectExpr(
        "retailer", "url", "concat(name, ' page') AS name", "brand", "style_code", "currency",
        "price * CASE part_id % 7 WHEN 1 THEN 1.2D WHEN 2 THEN 0.9D ELSE 1.0D END AS price",
        "part_id % 5 <> 0 AS in_stock", "part_id % 2 = 0 AS on_sale",
        "CASE WHEN part_id % 4 = 0 THEN list_price END AS list_price", "true AS price_verified",
        "array(named_struct('label', '42', 'in_stock', part_id % 11 <> 0)) AS sizes",
        "part_id % 13 = 0 AS size_stock_unverified", "scraped_at",
    )


@query("confirm_pages", """
    SELECT retailer, url, CASE WHEN part_id % 10 = 1 THEN name ELSE name || ' page' END AS name,
           CASE WHEN part_id % 10 = 1 THEN price ELSE price * CASE part_id % 7 WHEN 1 THEN 1.2 WHEN 2 THEN 0.9 ELSE 1.0 END::DOUBLE END AS price,
           CASE WHEN part_id % 10 = 1 THEN on_sale ELSE part_id % 2 = 0 OR on_sale END AS on_sale, list_price, extra_cost_eur
    FROM offer_costed
    WHERE CASE WHEN part_id % 10 = 1 THEN in_stock AND price <= 120 ELSE part_id % 3 <> 0 AND part_id % 5 <> 0
          AND price * CASE part_id % 7 WHEN 1 THEN 1.2 WHEN 2 THEN 0.9 ELSE 1.0 END::DOUBLE <= 120 END
""", ("offer_costed",))
def confirm_pages(spark, sf):
    """Grid rows replaced by their page read, policy carried over, judged again."""
    c = v.config()
    c = replace(c, filters=replace(c.filters, max_retail_price=120.0))
    rows = costed_offers(spark, sf).withColumn("price_verified", F.col("part_id") % 10 == 1)
    out = screen.confirm(rows, _detail(spark, sf).drop("sizes", "size_stock_unverified"), c)
    return out.select("retailer", "url", "name", "price", "on_sale", "list_price", "extra_cost_eur")


@query("alert_recheck", f"""
    WITH a AS (
      SELECT retailer, url, part_id, variant_id, o.price, o.landed_cost, highest_bid, num_bids, on_sale, o.discount_pct, o.sale_discount_pct, extra_cost_eur,
             CASE WHEN part_id % 2 = 0 THEN '42' ELSE '43' END AS label
      FROM offer_costed o JOIN market m ON o.product_id = m.product_id
      WHERE part_id % 3 <> 0 AND num_bids >= 1 AND {v.profit_sql('highest_bid', 'landed_cost')} >= 0),
    p AS (SELECT *, price * CASE part_id % 7 WHEN 1 THEN 1.2 WHEN 2 THEN 0.9 ELSE 1.0 END::DOUBLE AS page_price,
             part_id % 5 = 0 OR (part_id % 13 <> 0 AND (label <> '42' OR part_id % 11 = 0)) AS gone FROM a),
    c AS (SELECT *, CASE WHEN on_sale THEN page_price * (1 - discount_pct) * (1 - sale_discount_pct) ELSE page_price * (1 - discount_pct) END + extra_cost_eur AS page_cost FROM p)
    SELECT retailer || '|' || variant_id || '|' || label || '|' || part_id AS key, CASE WHEN gone THEN 'gone'
      WHEN page_price > price + 0.01::DOUBLE AND {v.profit_sql('highest_bid', 'page_cost')} < 0 THEN 'unprofitable' ELSE 'good' END AS outcome FROM c
""", ("offer_costed", "market"))
def alert_recheck(spark, sf):
    """Alerts against the newest page read: still good, gone, or too dear now."""
    c = v.config()
    m = v.market(spark, sf).drop("fetched_at", "size")
    label = F.expr("CASE WHEN part_id % 2 = 0 THEN '42' ELSE '43' END")
    rows = costed_offers(spark, sf).withColumn("size_label", label).withColumn("price_verified", F.lit(False))
    rows = dealt_by(rows, ["retailer", "url"])
    made = opportunity.build(rows.join(sent_if_small(m), "product_id"), c).withColumn(
        "key", F.concat_ws("|", "key", F.col("part_id").cast("string"))
    )
    good, gone, lost = alerts.recheck(made, _detail(spark, sf), c)
    return (
        good.select("key", F.lit("good").alias("outcome"))
        .unionByName(gone.select("key", F.lit("gone").alias("outcome")))
        .unionByName(lost.select("key", F.lit("unprofitable").alias("outcome")))
    )


@query("preferred_sibling", """
    WITH sib AS (SELECT style_code, min_by(price, url) AS price, min(url) AS url, min_by(in_stock, url) AS s, min_by(part_id, url) AS part_id
                 FROM offer WHERE retailer = 'shop5' AND style_code IS NOT NULL GROUP BY style_code)
    SELECT o.url, CASE WHEN s.s THEN 'shop5 sells it too, at ' || printf('%.2f', floor(s.price * 100 + 0.5) / 100) || ' EUR, ' ||
        CASE WHEN o.part_id % 4 = 0 THEN 'in stock' WHEN s.part_id % 3 = 0 THEN 'stock of sizes not stated'
             WHEN o.part_id % 4 = 1 THEN 'also in 42' ELSE 'but in 42, 43' END
        || ' - ' || s.url END AS note
    FROM offer o LEFT JOIN sib s USING (style_code) WHERE o.retailer = 'shop6'
""", ("offer",))
def preferred_sibling(spark, sf):
    """Notes for shop6, whose preferred sibling is shop5."""
    sized = v.offer(spark, sf).withColumns(
        {
            "sizes": F.expr("""transform(array('42', '43', '44'), x -> named_struct('label', x,
                'in_stock', CASE WHEN part_id % 3 = 0 THEN NULL ELSE x <> '44' END))"""),
            # whole cents, so that both engines print the same digits
            "price": F.floor(F.col("price") * 100 + 0.5) / 100,
        }
    )
    opps = v.offer(spark, sf).filter("retailer = 'shop6'").withColumns(
        {
            "size_label": F.expr("CASE part_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '42' ELSE '46' END"),
            "extra_cost_eur": F.lit(0.0),
        }
    )
    out = alerts.with_sibling(opps, v.config().policy_frame(spark), sized)
    return out.select("url", F.col("prefer_note").alias("note"))


def _cents(x: str) -> str:
    return f"printf('%.2f', floor(({x}) * 100 + 0.5) / 100)"


_SOLD, _ASKED = v.payout_sql("value"), v.payout_sql("(value + 20)")
_SECOND = "0.876::DOUBLE"


@query("alert_text", f"""
    WITH t AS (SELECT event_id, user_id, value, event_id % 3 AS kind, {_SOLD} - 30.0::DOUBLE AS now_, {_ASKED} - 30.0::DOUBLE AS later,
                 CASE WHEN value > 0 THEN {_SOLD} END AS paid FROM events)
    SELECT event_id, concat_ws(chr(10),
      'Shoe: ' || CASE WHEN value > 0 AND now_ > 0 THEN 'pays at the current bid' ELSE 'may pay if listed' END || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' (restock)' END,
      'Code AB-' || user_id || CASE kind WHEN 0 THEN ', no sizes, sneakers; Marketplace takes it sealed only'
        WHEN 1 THEN ', size 42 EU (? US) by its bid - the shop does not say whether it has it' ELSE ', size 42 EU (? US)' END,
      'Price at shop1: 30.00 EUR',
      CASE WHEN event_id % 4 = 0 THEN 'Buying: forwarded' END,
      CASE WHEN value > 0 THEN 'At the bid: ' || {_cents('value')} || ' EUR, ' || {_cents(_SOLD)} || ' paid out, ' || {_cents('now_')} || ' gained' ELSE 'At the bid: nobody bids' END,
      'At the ask: ' || {_cents('value + 20')} || ' EUR, ' || {_cents(_ASKED)} || ' paid out, ' || {_cents('later')} || ' gained',
      'Market: bid ' || {_cents('value')} || ', ask ' || {_cents('value + 20')},
      'Match 1.00' || CASE kind WHEN 0 THEN '' ELSE ', size by chart' END || ', score ' || {_cents(v.round_sql("(now_ * CASE WHEN now_ > 0 THEN 2.0 ELSE 1.0 END::DOUBLE)", 100))},
      'Shop page: https://s/x', 'Marketplace page: https://marketplace.example/slug',
      'Second venue is better from ' || {_cents(f'(coalesce(paid, {_ASKED}) + 5.0::DOUBLE + 7.0::DOUBLE) / {_SECOND}')} || ' EUR: https://second-venue.example/search?query=AB-' || user_id) AS text
    FROM t WHERE value > 0
""")
def alert_text(spark, sf):
    """Every line of every message."""
    c = v.config()
    rows = v.events(spark, sf).selectExpr(
        "event_id", "concat('v', user_id) AS variant_id", "'shop1' AS retailer", "'https://s/x' AS url", "30.0D AS landed_cost",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE '42' END AS size_label", "cast(NULL AS string) AS us_size",
        "event_id % 3 = 1 AS size_stock_unverified", "concat('AB-', user_id) AS style_code", "'sneakers' AS category",
        "value AS highest_bid", "value + 20 AS lowest_ask", "cast(NULL AS int) AS num_asks", "cast(NULL AS int) AS num_bids",
        "cast(NULL AS int) AS sales_72h", "cast(NULL AS double) AS last_sale", "30.0D AS price", "0.0D AS discount_pct",
        "0.0D AS sale_discount_pct", "0.0D AS extra_cost_eur", "false AS on_sale", "true AS price_verified",
        "CASE WHEN event_id % 4 = 0 THEN 'forwarded' END AS buy_note", "'' AS stock_note", "cast(NULL AS string) AS prefer_note",
        "CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'restock' END AS reason", "'Shoe' AS title", "'Shoe' AS name",
        "1.0D AS confidence", "'size chart' AS size_match_method", "'slug' AS url_key", "'S-1' AS style_id", "'p1' AS product_id",
    )
    low = replace(c, filters=replace(c.filters, min_profit=-1e9, min_bids=0))
    return opportunity.build(rows, low).select("event_id", alerts.alert_text(c).alias("text"))


@query("live_report", f"""
    WITH a AS (SELECT url, retailer, part_id, m.variant_id, m.highest_bid AS bid, CASE WHEN part_id % 6 = 0 THEN NULL ELSE m.size END AS label,
                      o.discount_pct, o.sale_discount_pct, o.extra_cost_eur, o.on_sale, price, in_stock
               FROM offer_costed o JOIN market m ON o.product_id = m.product_id),
    c AS (SELECT *, CASE WHEN on_sale THEN price * (1 - discount_pct) * (1 - sale_discount_pct) ELSE price * (1 - discount_pct) END + extra_cost_eur AS cost FROM a)
    SELECT url, variant_id, CASE WHEN NOT in_stock OR part_id % 9 = 0 THEN 'out of stock' WHEN bid IS NULL THEN 'no live bid'
             WHEN {v.profit_sql('bid', 'cost')} < 0 THEN 'below floor' ELSE 'live' END AS status,
           CASE WHEN label IS NULL THEN 'no size (single variant)' WHEN part_id % 9 = 0 OR (part_id % 4 = 0 AND label = '42') THEN 'size stock UNKNOWN'
                WHEN (part_id % 4 = 1 AND label = '42') OR (part_id % 4 = 3 AND label = '43') THEN 'size in stock' ELSE 'SIZE NOT IN STOCK' END AS size_flag,
           CASE WHEN part_id % 9 <> 0 THEN {v.profit_sql('bid', 'cost')} END AS live_profit
    FROM c
""", ("offer_costed", "market"))
def live_report(spark, sf):
    """Every recorded alert re-priced on the current listing and bid."""
    return _verified(spark, sf).select("url", "variant_id", "status", "size_flag", "live_profit")


def _record(pairs):
    """An alert for each variant of an offer's product."""
    return pairs.selectExpr(
        "retailer", "url", "variant_id", "CASE WHEN part_id % 6 = 0 THEN NULL ELSE size END AS size_label",
        "discount_pct", "sale_discount_pct", "extra_cost_eur", "on_sale", "concat(retailer, '|', url, '|', variant_id) AS key",
    )


def _current(spark, sf):
    return v.offer(spark, sf).filter("part_id % 9 <> 0").selectExpr(
        "retailer", "url", "price", "in_stock",
        """CASE part_id % 4 WHEN 0 THEN array(named_struct('label', '42', 'in_stock', cast(NULL AS boolean)))
           WHEN 1 THEN array(named_struct('label', '42', 'in_stock', true)) WHEN 2 THEN array(named_struct('label', '42', 'in_stock', false))
           ELSE array(named_struct('label', '43', 'in_stock', true)) END AS sizes""",
    )


def _verified(spark, sf):
    m = materialize(v.market(spark, sf))
    recorded = _record(dealt_by(costed_offers(spark, sf), ["retailer", "url"]).join(
        sent_if_small(m.select("product_id", "variant_id", "size")), "product_id"
    ))
    return report.verify(recorded, _current(spark, sf), m, v.config())


@query("live_report_top", f"""
    WITH c AS (SELECT o.url, variant_id, retailer || '|' || o.url || '|' || variant_id AS key, in_stock, part_id, landed_cost AS cost, m.highest_bid AS bid
               FROM offer_costed o JOIN market m ON o.product_id = m.product_id)
    SELECT url, variant_id, {v.profit_sql('bid', 'cost')} AS live_profit FROM c
    WHERE in_stock AND part_id % 9 <> 0 AND {v.profit_sql('bid', 'cost')} >= 0 ORDER BY live_profit DESC, key LIMIT 25
""", ("offer_costed", "market"))
def live_report_top(spark, sf):
    m = materialize(v.market(spark, sf))
    sizes = m.select("product_id", "variant_id", "size")
    top = report.top_live(costed_offers(spark, sf), sizes, _record, _current(spark, sf), m, v.config(), 25)
    return top.select("url", "variant_id", "live_profit")


@query("bid_transitions", f"""
    WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('purchase', 'click', 'view') THEN value END AS bid FROM events),
    l AS (SELECT *, lag(bid) OVER w AS last_bid, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, last_bid, CASE WHEN rn = 1 THEN 'baseline' WHEN bid IS NULL AND last_bid IS NOT NULL THEN 'bid_gone'
      WHEN bid IS NOT NULL AND last_bid IS NULL THEN 'bid_back' WHEN abs(bid - last_bid) >= 25 THEN 'bid_moved'
      WHEN {v.profit_sql('bid', '40.0::DOUBLE')} < 0 AND {v.profit_sql('last_bid', '40.0::DOUBLE')} >= 0 THEN 'underwater' ELSE 'none' END AS event
    FROM l
""")
def bid_transitions(spark, sf):
    """What each bid check of each variant says against the one before."""
    checks = v.events(spark, sf).selectExpr(
        "event_id", "concat('v', user_id) AS variant_id", "ts",
        "CASE WHEN event_type IN ('purchase', 'click', 'view') THEN value END AS bid", "40.0D AS paid", "25.0D AS move",
    )
    out = watch.transitions(checks, [F.col("ts"), F.col("event_id")], v.config())
    return out.select("event_id", "last_bid", "event")


@query("discount_leaders", """
    SELECT retailer, url, discount_rank, row_number() OVER (PARTITION BY retailer ORDER BY discount_rank DESC, ordinal, url) AS place
    FROM offer_costed QUALIFY place <= 10
""", ("offer_costed",))
def discount_leaders(spark, sf):
    return top_n_per_group(
        costed_offers(spark, sf), ["retailer"], [F.desc("discount_rank"), F.asc("ordinal"), F.asc("url")], 10, rank="place"
    ).select("retailer", "url", "discount_rank", "place")
