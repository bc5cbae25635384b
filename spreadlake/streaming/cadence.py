"""Which products to read anew, kept up to date as quotes arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spreadlake.config import EngineConfig
from spreadlake.operators import quotes
from spreadlake.streaming.batches import BatchOutput, StateLog

INPUT = "variant_id string, fetched_at timestamp"
STATE = INPUT

# With timers: one line for each variant, watch row and quote of a product. At one time,
# variants come first, then watch rows, then quotes.
LINES = "product_id string, at timestamp, kind int, variant_id string, best_profit double"
DUE = "product_id string, due_at timestamp, ttl_minutes int"
VARIANT, WATCH, QUOTE = 0, 1, 2
NEVER = -(1 << 62)


def due_time(config: EngineConfig, assessed: bool, best: float | None, fetched: dict[str, int]) -> tuple[int, int]:
    """(minutes a product's quotes may be old, microseconds at which the oldest is older),
    by the tiers of `quotes.ttl_minutes`."""
    venue = config.venue
    if not assessed:
        minutes = venue.refresh_minutes_hot
    elif best is None:
        minutes = venue.refresh_minutes_cold
    else:
        gap = config.filters.min_profit - best
        minutes = (
            venue.refresh_minutes_hot if gap <= 0 else venue.refresh_minutes_warm if gap <= venue.near_miss
            else venue.refresh_minutes_cold)
    return minutes, min(fetched.values(), default=NEVER) + minutes * 60_000_000


def step(state: StateLog, output: BatchOutput, variants: DataFrame, watch: DataFrame, config: EngineConfig):
    """After each batch the output holds the products due at the time of the
    newest quote seen, under the batch's id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        state.put(batch_id, batch.groupBy("variant_id").agg(F.max("fetched_at").alias("fetched_at")))
        known = state.before(batch_id + 1)
        newest = known.agg(F.max("fetched_at").alias("t")).first()["t"]
        if newest is not None:
            output.put(batch_id, quotes.refresh_due(variants, known, watch, F.lit(newest), config).withColumn("as_of", F.lit(newest)))

    return run
