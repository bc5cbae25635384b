"""Cost, fees, profit, score, opportunities."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from spreadlake import config as cfg
from spreadlake.checks import views as v
from spreadlake.checks.registry import query
from spreadlake.functions import money
from spreadlake.operators import opportunity, quotes, screen
from spreadlake.operators.skew import lookup_join

FILTERS = cfg.SHIPPED.filters
FEES, VAT = cfg.SHIPPED.fees, cfg.SHIPPED.vat


def costed(spark, sf):
    c = v.config()
    stamped = screen.stamp_policy(v.listing(spark, sf).drop("discount_pct"), c.policy_frame(spark))
    return screen.with_costs(stamped)


def costed_offers(spark, sf):
    return screen.with_costs(screen.stamp_policy(v.offer(spark, sf), v.config().policy_frame(spark)))


@query("landed_cost", """
    SELECT l_orderkey, l_linenumber, retailer, landed_cost FROM costed
""", ("costed",))
def landed_cost(spark, sf):
    return costed(spark, sf).select("l_orderkey", "l_linenumber", "retailer", "landed_cost")


@query("standing_discount_cost", """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN on_sale THEN price * (1 - discount_pct) * (1 - 0.15::DOUBLE) ELSE price * (1 - discount_pct) END
             + 8.0::DOUBLE AS cost
    FROM listing
""", ("listing",))
def standing_discount_cost(spark, sf):
    c = money.landed_cost(F.col("price"), F.col("discount_pct"), F.lit(0.15), F.col("on_sale"), F.lit(8.0))
    return v.listing(spark, sf).select("l_orderkey", "l_linenumber", c.alias("cost"))


@query("discount_rank", """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN on_sale AND list_price > price THEN (list_price - price) / list_price ELSE 0.0::DOUBLE END AS discount_rank
    FROM listing
""", ("listing",))
def discount_rank(spark, sf):
    return costed(spark, sf).select("l_orderkey", "l_linenumber", "discount_rank")


@query("cheap_screen", """
    SELECT l_orderkey, l_linenumber, retailer, price FROM listing
    WHERE in_stock AND (style_code IS NOT NULL OR ean IS NOT NULL) AND price > 0 AND price <= 100 AND currency = 'EUR'
""", ("listing",))
def cheap_screen(spark, sf):
    narrow = replace(FILTERS, max_retail_price=100.0)
    return screen.cheap_screen(v.listing(spark, sf), narrow).select("l_orderkey", "l_linenumber", "retailer", "price")


@query("currency_drops", """
    SELECT retailer, count(*) FILTER (currency IS DISTINCT FROM 'EUR') AS other_currency FROM listing GROUP BY retailer
""", ("listing",))
def currency_drops(spark, sf):
    return screen.dropped_by_currency(v.listing(spark, sf))


@query("enabled_listings", """
    SELECT l_orderkey, l_linenumber, retailer FROM listing SEMI JOIN (SELECT retailer FROM policy WHERE enabled) USING (retailer)
""", ("listing", "policy"))
def enabled_listings(spark, sf):
    kept = screen.enabled_only(v.listing(spark, sf), v.config().policy_frame(spark))
    return kept.select("l_orderkey", "l_linenumber", "retailer")


@query("one_shop_listings", """
    SELECT l_orderkey, l_linenumber, retailer FROM listing WHERE retailer = 'shop5'
""", ("listing",))
def one_shop_listings(spark, sf):
    kept = screen.enabled_only(v.listing(spark, sf), v.config().policy_frame(spark), "shop5")
    return kept.select("l_orderkey", "l_linenumber", "retailer")


_COST = "30.0::DOUBLE"


@query("fee_breakdown", f"""
    SELECT event_id, value AS sale_price, {v.tx_sql('value')} AS transaction_fee, value * 0.03::DOUBLE AS processing_fee,
           10.0::DOUBLE AS shipping, {v.payout_sql('value')} AS payout, {v.payout_sql('value')} - {_COST} AS profit,
           ({v.payout_sql('value')} - {_COST}) / {_COST} AS margin_pct,
           ({v.payout_sql('value')} - {_COST}) / ({_COST} + 10.0::DOUBLE) AS roic
    FROM events
""")
def fee_breakdown(spark, sf):
    b = money.fee_breakdown(money.SELL_NOW, F.col("value"), F.lit(30.0), FEES, VAT)
    out = v.events(spark, sf).select("event_id", b.alias("b"))
    names = ("sale_price", "transaction_fee", "processing_fee", "shipping", "payout", "profit", "margin_pct", "roic")
    return out.select("event_id", *[f"b.{n}" for n in names])


_WEDGE = f"(0.0::DOUBLE + value * 0.24::DOUBLE / 1.24::DOUBLE - {_COST} * 0.24::DOUBLE / 1.24::DOUBLE)"


@query("vat_breakdown", f"""
    SELECT event_id, {_WEDGE} AS vat_wedge, {v.payout_sql('value', _WEDGE)} - {_COST} AS profit FROM events
""")
def vat_breakdown(spark, sf):
    vat = cfg.VatConfig(enabled=True, rate=0.24, input_vat_reclaimable=True, output_vat_on_sale=True)
    b = money.fee_breakdown(money.SELL_NOW, F.col("value"), F.lit(30.0), FEES, vat)
    return v.events(spark, sf).select("event_id", b.alias("b")).select("event_id", "b.vat_wedge", "b.profit")


@query("second_venue", f"""
    SELECT event_id, value * (1 - 0.095::DOUBLE - 0.029::DOUBLE) - 5.0::DOUBLE - 7.0::DOUBLE AS payout_there,
           ({v.payout_sql('value')} + 5.0::DOUBLE + 7.0::DOUBLE) / (1 - 0.095::DOUBLE - 0.029::DOUBLE) AS breakeven
    FROM events
""")
def second_venue(spark, sf):
    b = money.fee_breakdown(money.SELL_NOW, F.col("value"), F.lit(30.0), FEES, VAT)
    venue = cfg.SHIPPED.second_venue
    return v.events(spark, sf).select(
        "event_id", money.second_venue_payout(F.col("value"), venue).alias("payout_there"),
        money.second_venue_breakeven(b["payout"], venue).alias("breakeven"),
    )


@query("gate_profit", f"""
    WITH s AS (SELECT variant_id, {v.profit_sql('highest_bid', _COST)} AS live, CASE WHEN lowest_ask > 0 THEN
           {v.payout_sql('greatest(lowest_ask - 5.0::DOUBLE, 0.0::DOUBLE)')} - {_COST} END AS listed FROM market)
    SELECT variant_id, live, greatest(live, listed) AS either, coalesce(greatest(live, listed), 0) AS best FROM s
""", ("market",))
def gate_profit(spark, sf):
    fees = replace(FEES, undercut=5.0)
    m = v.market(spark, sf)
    sell = money.sell_now(F.col("highest_bid"), F.lit(30.0), fees, VAT)["profit"]
    ask = money.list_ask(F.col("lowest_ask"), F.lit(30.0), fees, VAT)["profit"]
    return m.select(
        "variant_id", money.gate_profit(sell, ask, FILTERS).alias("live"),
        money.gate_profit(sell, ask, replace(FILTERS, require_live_bid=False)).alias("either"),
        money.best_profit(sell, ask).alias("best"),
    )


@query("days_to_clear", f"""
    SELECT variant_id, CASE WHEN sales_72h <> 0 THEN
      {v.round_sql('(greatest(num_asks, 1) / (sales_72h / 3.0::DOUBLE))', 10)} END AS days
    FROM market
""", ("market",))
def days_to_clear(spark, sf):
    return v.market(spark, sf).select(
        "variant_id", money.days_to_clear(F.col("sales_72h"), F.col("num_asks")).alias("days")
    )


_VALUE = v.profit_sql("highest_bid", "20.0::DOUBLE")
_FACTOR = (
    f"(CASE WHEN ({_VALUE}) > 0 THEN 2.0 ELSE 1.0 END::DOUBLE"
    " * CASE WHEN sales_72h <> 0 THEN 1.0::DOUBLE + least(sales_72h, 10) / 10.0::DOUBLE ELSE 1.0::DOUBLE END"
    " * CASE WHEN highest_bid IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE)"
)


@query("opportunity_score", f"""
    WITH s AS (SELECT variant_id, coalesce({_VALUE}, 1.0::DOUBLE) * {_FACTOR} AS score_raw FROM market)
    SELECT variant_id, score_raw, {v.round_sql('score_raw', 100)} AS score FROM s
""", ("market",))
def opportunity_score(spark, sf):
    profit = money.sell_now(F.col("highest_bid"), F.lit(20.0), FEES, VAT)["profit"]
    priced = v.market(spark, sf).withColumn("p", profit)
    args = (F.coalesce("p", F.lit(1.0)), F.col("p"), F.col("sales_72h"), F.col("highest_bid"))
    return priced.select(
        "variant_id", money.score_unrounded(*args).alias("score_raw"), money.opportunity_score(*args).alias("score")
    )


@query("opportunity_keys", """
    SELECT l_orderkey, l_linenumber, retailer || '|v' || part_id || CASE WHEN l_linenumber > 1 THEN '|' || size_label ELSE '' END AS key,
           retailer || '|' || product_id || '|unverified' AS product_key
    FROM listing
""", ("listing",))
def opportunity_keys(spark, sf):
    label = F.when(F.col("l_linenumber") > 1, F.col("size_label"))
    return v.listing(spark, sf).select(
        "l_orderkey", "l_linenumber",
        money.opportunity_key(F.col("retailer"), F.concat(F.lit("v"), "part_id"), label).alias("key"),
        money.unverified_key(F.col("retailer"), F.col("product_id")).alias("product_key"),
    )


@query("catalog_links", """
    SELECT product_id, 'https://m.example/' || CASE WHEN p_partkey % 3 > 0 THEN url_key
           WHEN style_id <> '' THEN 'search?s=' || style_id ELSE 'search?s=' || product_id END AS link
    FROM catalog
""", ("catalog",))
def catalog_links(spark, sf):
    slug = F.when(F.col("p_partkey") % 3 > 0, F.col("url_key")).otherwise("")
    return v.catalog(spark, sf).select(
        "product_id",
        money.catalog_url("https://m.example/", slug, F.col("style_id"), F.col("product_id")).alias("link"),
    )


def opportunities(spark, sf, config=None):
    """The flagship: every offered size against the latest quote of its variant,
    priced, gated and scored."""
    config = config or v.config()
    rows = screen.cheap_screen(costed(spark, sf), config.filters)
    quote = v.market(spark, sf).withColumnRenamed("size", "size_label").drop("fetched_at")
    priced = lookup_join(rows, quote, ["product_id", "size_label"], "inner")
    return opportunity.build(priced, config)


_OPP = f"""
    FROM costed c JOIN market m ON c.product_id = m.product_id AND c.size_label = m.size
    WHERE in_stock AND (style_code IS NOT NULL OR ean IS NOT NULL) AND price > 0 AND price <= 500 AND currency = 'EUR'
      AND {v.profit_sql('highest_bid', 'landed_cost')} >= 0 AND num_bids >= 1 AND sales_72h >= 0
"""


@query("opportunities", f"""
    SELECT l_orderkey, l_linenumber, retailer || '|' || variant_id || '|' || size_label AS key, landed_cost,
           highest_bid, {v.profit_sql('highest_bid', 'landed_cost')} AS gate_profit
    {_OPP}
""", ("costed", "market"))
def opportunities_query(spark, sf):
    return opportunities(spark, sf).select(
        "l_orderkey", "l_linenumber", "key", "landed_cost", "highest_bid", "gate_profit"
    )


@query("top_opportunities", f"""
    SELECT l_orderkey, l_linenumber, price, {v.profit_sql('highest_bid', 'landed_cost')} AS gate_profit
    {_OPP}
    ORDER BY gate_profit DESC, l_orderkey, l_linenumber, price LIMIT 50
""", ("costed", "market"))
def top_opportunities(spark, sf):
    return opportunities(spark, sf).select("l_orderkey", "l_linenumber", "price", "gate_profit").orderBy(
        F.desc("gate_profit"), "l_orderkey", "l_linenumber", "price"
    ).limit(50)


@query("liquidity_floors", """
    SELECT variant_id, num_bids >= 3 AND sales_72h >= 1 AS known_ok, num_bids >= 3 AS bids_only
    FROM market
""", ("market",))
def liquidity_floors(spark, sf):
    floors = replace(FILTERS, min_bids=3, min_sales_72h=1)
    none = F.lit(None).cast("int")
    return v.market(spark, sf).select(
        "variant_id", money.liquidity_ok(F.col("num_bids"), F.col("sales_72h"), floors).alias("known_ok"),
        money.liquidity_ok(F.col("num_bids"), none, floors).alias("bids_only"),
    )


@query("best_upside", f"""
    SELECT retailer, url, max({v.profit_sql('highest_bid', 'landed_cost')}) AS best_upside
    FROM offer_costed JOIN market USING (product_id) GROUP BY retailer, url
""", ("offer_costed", "market"))
def best_upside(spark, sf):
    scored = quotes.assess(costed_offers(spark, sf), v.market(spark, sf), v.config())
    return scored.select("retailer", "url", "best_upside")


@query("upside_gate", f"""
    SELECT retailer, url, landed_cost FROM offer_costed JOIN market USING (product_id)
    GROUP BY retailer, url, landed_cost HAVING max({v.profit_sql('highest_bid', 'landed_cost')}) >= 60
""", ("offer_costed", "market"))
def upside_gate(spark, sf):
    c = replace(v.config(), filters=replace(FILTERS, min_profit=60.0))
    scored = quotes.assess(costed_offers(spark, sf), v.market(spark, sf), c)
    return quotes.upside_gate(scored, c).select("retailer", "url", "landed_cost")


@query("watch_figures", f"""
    SELECT product_id, max({v.profit_sql('highest_bid', 'landed_cost')}) AS best_profit
    FROM offer_costed JOIN market USING (product_id) GROUP BY product_id
""", ("offer_costed", "market"))
def watch_figures(spark, sf):
    scored = quotes.assess(costed_offers(spark, sf), v.market(spark, sf), v.config())
    return quotes.watch_rows(scored, v.now()).select("product_id", "best_profit")


@query("scan_order", """
    SELECT retailer, url, discount_rank, ordinal FROM offer_costed ORDER BY discount_rank DESC, ordinal LIMIT 100
""", ("offer_costed",))
def scan_order(spark, sf):
    return screen.in_scan_order(costed_offers(spark, sf), "ordinal", 100).select(
        "retailer", "url", "discount_rank", "ordinal"
    )
