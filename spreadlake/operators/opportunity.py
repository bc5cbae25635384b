"""Opportunities: scenarios, gate, liquidity, score, collapse, review gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.config import EngineConfig
from spreadlake.functions import money, style
from spreadlake.operators.quotes import variant_gate


def build(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """Keep rows whose gate profit clears the floor and whose liquidity is not
    known to be too thin, and score them. Needs `landed_cost`, a quote's columns,
    `retailer`, `variant_id` and `size_label`."""
    gated = variant_gate(rows, F.col("landed_cost"), config).filter(
        (F.col("sell_now").isNotNull() | F.col("list_ask").isNotNull())
        & (F.col("gate_profit") >= config.filters.min_profit)
        & money.liquidity_ok(F.col("num_bids"), F.col("sales_72h"), config.filters)
    )
    args = (F.col("gate_profit"), F.col("sell_now.profit"), F.col("sales_72h"), F.col("highest_bid"))
    return gated.withColumns(
        {
            "est_days_to_clear": money.days_to_clear(F.col("sales_72h"), F.col("num_asks")),
            "best_profit": money.best_profit(F.col("sell_now.profit"), F.col("list_ask.profit")),
            "score": money.opportunity_score(*args),
            "score_raw": money.score_unrounded(*args),
            "key": money.opportunity_key(F.col("retailer"), F.col("variant_id"), F.col("size_label")),
        }
    )


def collapse_unverified(rows: DataFrame) -> DataFrame:
    """Listings whose shop hides per-size stock keep their best-score size under
    a product-level key; the first size wins a tie. The choice is an aggregate,
    so it happens before the shuffle."""
    names = [c for c in rows.columns if c not in ("retailer", "url")]
    unverified = F.coalesce(F.col("size_stock_unverified"), F.lit(False))
    best = (
        rows.filter(unverified).groupBy("retailer", "url")
        .agg(F.min_by(F.struct(*names), F.struct(-F.col("score"), F.col("size_pos"))).alias("_o"))
        .select("retailer", "url", "_o.*")
        .withColumn("key", money.unverified_key(F.col("retailer"), F.col("product_id")))
    )
    return rows.filter(~unverified).unionByName(best)


def region_review(rows: DataFrame, title: Column, name: Column) -> DataFrame:
    """Add `region_blocker`: the marker the retail name does not confirm."""
    return rows.withColumn("region_blocker", style.region_mismatch(title, name))


def report_order(rows: DataFrame, by_score: bool = False) -> list[Column]:
    """Emission order of a scan: discount order, or by score when asked."""
    first = [F.desc("score")] if by_score else [F.desc("discount_rank"), F.asc("ordinal")]
    return [*first, F.asc("size_pos"), F.asc("key")]
