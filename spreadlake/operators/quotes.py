"""Bid/ask quotes: latest, as-of, freshness, cadence, budget, upside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.config import EngineConfig, FilterConfig, VenueConfig
from spreadlake.functions import money
from spreadlake.functions.times import is_fresh
from spreadlake.operators.ordered import LastKnown, RowNumber, top_n_per_group, with_ordered
from spreadlake.operators.skew import lookup_join
from spreadlake.session import materialize


def latest(history: DataFrame) -> DataFrame:
    """Newest quote per variant. The maximum is taken before the shuffle, so a
    variant with most of the history costs one row per task."""
    names = [c for c in history.columns if c != "variant_id"]
    tie = [F.col(c) for c in ("fetched_at", "highest_bid", "lowest_ask") if c in names]
    return history.groupBy("variant_id").agg(
        F.max_by(F.struct(*names), F.struct(*tie)).alias("_q")
    ).select("variant_id", "_q.*")


def as_of(probes: DataFrame, history: DataFrame, probe_time: str, carry: list[str]) -> DataFrame:
    """Newest quote at or before each probe's time.

    Quotes and probes are laid on one time line per variant and the last quote
    is carried forward; the ordered scan splits a large variant by time.
    """
    probe_columns = [c for c in probes.columns if c != "variant_id"]
    quote = F.struct(*[F.col(c).alias(c) for c in ["fetched_at", *carry]])
    line = (
        history.select("variant_id", F.col("fetched_at").alias("_at"), F.lit(0).alias("_side"), quote.alias("_quote"))
        .unionByName(
            probes.select(
                "variant_id", F.col(probe_time).alias("_at"), F.lit(1).alias("_side"),
                F.struct(*probe_columns).alias("_probe"),
            ),
            allowMissingColumns=True,
        )
    )
    order = [F.col("_at"), F.col("_side"), F.xxhash64("_quote", "_probe")]
    filled = with_ordered(line, ["variant_id"], order, _seen=LastKnown(F.col("_quote")))
    return filled.filter("_side = 1").select(
        "variant_id", "_probe.*",
        F.col("_seen.fetched_at").alias("quote_at"), *[F.col(f"_seen.{c}").alias(c) for c in carry],
    )


def ttl_minutes(venue: VenueConfig, filters: FilterConfig, assessed: Column, best_profit: Column) -> Column:
    """How old may a product's quotes be? Never assessed: hot. Assessed with no
    bid anywhere: cold. Otherwise by the gap to the profit floor."""
    gap = F.lit(filters.min_profit) - best_profit
    return (
        F.when(~assessed, F.lit(venue.refresh_minutes_hot))
        .when(best_profit.isNull(), F.lit(venue.refresh_minutes_cold))
        .when(gap <= 0, F.lit(venue.refresh_minutes_hot))
        .when(gap <= venue.near_miss, F.lit(venue.refresh_minutes_warm))
        .otherwise(F.lit(venue.refresh_minutes_cold))
    )


def with_ttl(rows: DataFrame, watch: DataFrame, config: EngineConfig) -> DataFrame:
    """Add `ttl_minutes`; a missing watch row differs from a NULL profit."""
    marked = watch.select("product_id", F.col("best_profit").alias("_best"), F.lit(True).alias("_assessed"))
    joined = rows.join(marked, "product_id", "left")
    tier = ttl_minutes(
        config.venue, config.filters, F.coalesce("_assessed", F.lit(False)), F.col("_best")
    )
    return joined.withColumn("ttl_minutes", tier).drop("_best", "_assessed")


def freshness(variants: DataFrame, quotes: DataFrame, product_ttl: DataFrame, now: Column) -> DataFrame:
    """Per product: are quotes of *every* variant fresh enough to be reused?"""
    joined = (
        variants.select("product_id", "variant_id")
        .join(quotes.select("variant_id", "fetched_at"), "variant_id", "left")
        .join(product_ttl, "product_id")
    )
    fresh = is_fresh(F.col("fetched_at"), now, F.col("ttl_minutes"))
    return joined.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.count_if(fresh).alias("n_fresh"),
        F.bool_and(fresh).alias("all_fresh"),
    )


def refresh_due(variants: DataFrame, quotes: DataFrame, watch: DataFrame, now: Column, config: EngineConfig) -> DataFrame:
    """Products to read anew, with their cadence: not every variant has a quote
    as fresh as the product's tier asks for."""
    products = with_ttl(variants.select("product_id").distinct(), watch, config)
    state = freshness(variants, quotes, products, now)
    return state.filter(~F.col("all_fresh")).join(products, "product_id")


def within_budget(
    candidates: DataFrame, needs_call: Column, order: list[Column], calls: int, stale: Column | None = None
) -> DataFrame:
    """Candidates the call budget of their shop's scan still reaches: those that
    need no call, and the first `calls` that do.

    `stale` marks listings whose product's quotes are too old. One call brings those
    of a product, so they are charged once for each shop and product, to the first
    listing in order that costs a call; later ones are served by it, if it was reached.
    """
    marked = candidates.withColumns({
        "_needs": F.coalesce(needs_call, F.lit(False)),
        "_stale": F.coalesce(stale, F.lit(False)) if stale is not None else F.lit(False),
    })
    costly = marked.filter(F.col("_needs") | F.col("_stale"))
    if stale is None:
        charged, served = costly, None
    else:
        turned = materialize(with_ordered(costly, ["retailer", "product_id"], order, _turn=RowNumber()))
        first = F.col("_turn") == 1
        charged, served = turned.filter(F.col("_needs") | first).drop("_turn"), turned.filter(~F.col("_needs") & ~first).drop("_turn")
    reached = top_n_per_group(charged, ["retailer"], order, calls)
    out = marked.filter(~F.col("_needs") & ~F.col("_stale")).unionByName(reached)
    if served is not None:
        reached_products = reached.select("retailer", "product_id").distinct()
        out = out.unionByName(served.join(reached_products, ["retailer", "product_id"], "left_semi"))
    return out.drop("_needs", "_stale")


def variant_gate(quotes: DataFrame, cost: Column, config: EngineConfig) -> DataFrame:
    """Add both scenarios and the gate profit at a given cost."""
    out = quotes.withColumns(
        {
            "sell_now": money.sell_now(F.col("highest_bid"), cost, config.fees, config.vat),
            "list_ask": money.list_ask(F.col("lowest_ask"), cost, config.fees, config.vat),
        }
    )
    return out.withColumn(
        "gate_profit", money.gate_profit(F.col("sell_now.profit"), F.col("list_ask.profit"), config.filters)
    )


def best_prices(quotes: DataFrame) -> DataFrame:
    """Highest bid and highest ask per product. Profit rises with the sale price
    as long as the percentage fees stay below 100 %, so the best upside of any
    listing follows from these two numbers: a listing never has to be joined
    with all variants of its product."""
    return quotes.groupBy("product_id").agg(
        F.max(F.when(F.col("highest_bid") > 0, F.col("highest_bid"))).alias("top_bid"),
        F.max(F.when(F.col("lowest_ask") > 0, F.col("lowest_ask"))).alias("top_ask"),
    )


def best_upside(cost: Column, config: EngineConfig) -> Column:
    """Largest gate profit over a product's variants, from `best_prices`; NULL
    when no variant can be sold."""
    bid = money.sell_now(F.col("top_bid"), cost, config.fees, config.vat)
    ask = money.list_ask(F.col("top_ask"), cost, config.fees, config.vat)
    return money.gate_profit(bid["profit"], ask["profit"], config.filters)


def assess(listing: DataFrame, quotes: DataFrame, config: EngineConfig) -> DataFrame:
    """Listings with `best_upside`."""
    fees = config.fees.transaction_fee_pct + config.fees.processing_fee_pct
    if fees + (config.vat.rate if config.vat.enabled else 0.0) >= 1:
        raise ValueError("percentage fees of 100 % or more: the dearest quote is not the best one")
    return lookup_join(listing, best_prices(quotes), ["product_id"]).withColumn(
        "best_upside", best_upside(F.col("landed_cost"), config)
    ).drop("top_bid", "top_ask")


def watch_rows(assessed: DataFrame, now: Column) -> DataFrame:
    """A product's watch row holds the best figure any of its listings reached. Only
    listings whose quotes were in hand may be passed: a product nobody looked at has
    no watch row."""
    return assessed.groupBy("product_id").agg(F.max("best_upside").alias("best_profit")).withColumn("checked_at", now)


def upside_gate(listing: DataFrame, config: EngineConfig) -> DataFrame:
    return listing.filter(F.col("best_upside") >= config.filters.min_profit)
