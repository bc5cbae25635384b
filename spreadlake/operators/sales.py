"""Realised sales against the fee model's prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spreadlake.config import EngineConfig
from spreadlake.functions import money


def with_prediction(sales: DataFrame, config: EngineConfig) -> DataFrame:
    """Predicted payout at the recorded bid; none without a bid."""
    offer = money.sell_now(F.col("bid_eur"), F.col("paid_eur"), config.fees, config.vat)
    return sales.withColumn("predicted_payout", offer["payout"])


def outcomes(sales: DataFrame) -> DataFrame:
    profit = F.col("payout_eur") - F.col("paid_eur")
    gap = F.col("payout_eur") - F.col("predicted_payout")
    verdict = F.when(gap < 0, "model OPTIMISTIC").when(gap > 0, "model conservative")
    return sales.withColumns(
        {
            "profit": profit,
            "profit_pct": F.try_divide(profit, F.col("paid_eur")) * 100,
            "model_gap": gap,
            "verdict": verdict,
        }
    )


def calibration(sales: DataFrame) -> DataFrame:
    """Mean gap of payout to prediction, over sales that have one. Gaps are summed as
    decimals of twelve places, so the row order cannot change the figure, and only the
    mean is a double again."""
    gap = F.when(
        F.col("predicted_payout").isNotNull(), (F.col("payout_eur") - F.col("predicted_payout")).cast("decimal(28,12)")
    )
    return sales.agg(F.count(gap).alias("n"), F.sum(gap).alias("gap")).select(
        "n", F.try_divide(F.col("gap").cast("double"), F.col("n").cast("double")).alias("mean_gap"))


def by_date(sales: DataFrame) -> DataFrame:
    return sales.orderBy("sold_at")
