"""Watching the bid on a position already bought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.config import EngineConfig
from spreadlake.functions import money
from spreadlake.operators.ordered import Previous, with_ordered

BASELINE, GONE, BACK, MOVED, UNDERWATER, NONE = (
    "baseline", "bid_gone", "bid_back", "bid_moved", "underwater", "none"
)


def transition(first: Column, bid: Column, last: Column, paid: Column, move: Column, config: EngineConfig) -> Column:
    """What a new bid means against the one before: one event, in this order."""

    def profit(b: Column) -> Column:
        return money.sell_now(b, paid, config.fees, config.vat)["profit"]

    now_pays, paid_before = F.coalesce(profit(bid) >= 0, F.lit(False)), F.coalesce(profit(last) >= 0, F.lit(False))
    return (
        F.when(first, BASELINE)
        .when(bid.isNull() & last.isNotNull(), GONE)
        .when(bid.isNotNull() & last.isNull(), BACK)
        .when(F.abs(bid - last) >= move, MOVED)
        .when(bid.isNotNull() & ~now_pays & paid_before, UNDERWATER)
        .otherwise(NONE)
    )


def transitions(checks: DataFrame, order: list[Column], config: EngineConfig) -> DataFrame:
    """Event per check of each variant. Needs `variant_id`, `bid`, `paid` and
    `move`. Slow drift below `move` per step is never reported, as the step is
    measured from the previous check."""
    lagged = with_ordered(checks, ["variant_id"], order, _before=Previous(F.col("bid")))
    last = F.col("_before.value")
    return lagged.withColumn("last_bid", last).withColumn(
        "event",
        transition(F.col("_before").isNull(), F.col("bid"), F.col("last_bid"), F.col("paid"), F.col("move"), config),
    ).drop("_before")
