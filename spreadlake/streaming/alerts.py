"""Alert dedup over streams of offers and delivery receipts.

State moves on a receipt, not on emission: an alert nobody confirmed as
delivered comes up again with the next offer for its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spreadlake.operators import alerts
from spreadlake.operators.ordered import LastKnown, RunningSum, top_n_per_group, with_ordered
from spreadlake.session import materialize
from spreadlake.streaming.batches import BatchOutput, StateLog

OFFER, DELIVERED, GONE = "offer", "delivered", "gone"

# Offers, receipts and stock losses share one line; `profit` and `in_stock`
# belong to the first two.
INPUT = "key string, at timestamp, kind string, profit double, in_stock boolean, payload string"
STATE = "key string, at timestamp, last_profit double, was_in_stock boolean"


def _order() -> list:
    """What was known before the batch comes first, whatever its time, so that a
    late row is judged against it; then by time, receipts and losses before offers."""
    side = F.when(F.col("kind") == OFFER, 1).otherwise(0)
    return [F.when(F.col("_anchor"), 0).otherwise(1), F.col("at"), side, F.xxhash64("kind", "profit", "in_stock", "payload")]


def decide(line: DataFrame, delta: float) -> DataFrame:
    """Add the state before each row and, for offers, the reason. Receipts and
    losses at the same time as an offer come first."""
    received = F.col("kind") == DELIVERED
    known = with_ordered(
        line, ["key"], _order(),
        last_profit=LastKnown(F.when(received, F.col("profit"))),
        was_in_stock=LastKnown(F.when(received, F.col("in_stock")).when(F.col("kind") == GONE, F.lit(False))),
        news=RunningSum((F.col("kind") != OFFER).cast("bigint")),
    )
    reason = alerts.alert_reason(
        F.col("last_profit").isNotNull(), F.col("was_in_stock"), F.col("in_stock"), F.col("last_profit"),
        F.col("profit"), delta,
    )
    return known.withColumn("reason", F.when(F.col("kind") == OFFER, reason))


def step(state: StateLog, output: BatchOutput, delta: float):
    """The `foreachBatch` function: alerts out, touched state kept."""

    def run(batch: DataFrame, batch_id: int) -> None:
        anchors = state.touched(batch_id, batch).select(
            "key", "at", F.lit(DELIVERED).alias("kind"), F.col("last_profit").alias("profit"),
            F.col("was_in_stock").alias("in_stock"), F.lit(None).cast("string").alias("payload"), F.lit(True).alias("_anchor"),
        )
        decided = materialize(decide(batch.withColumn("_anchor", F.lit(False)).unionByName(anchors), delta))
        due = decided.filter(~F.col("_anchor") & (F.col("kind") == OFFER) & (F.col("reason") != alerts.DUPLICATE))
        # offers with no receipt or loss between them would be one alert told twice
        first = top_n_per_group(due, ["key", "news"], _order(), 1)
        output.put(batch_id, first.select("key", "at", "profit", "in_stock", "payload", "reason"))
        state.put(
            batch_id,
            decided.filter("last_profit IS NOT NULL").groupBy("key").agg(
                F.max_by(F.struct("at", "last_profit", "was_in_stock"), F.struct(*_order())).alias("s"),
            ).select("key", "s.at", "s.last_profit", "s.was_in_stock"),
        )

    return run
