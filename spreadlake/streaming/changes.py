"""Change feed of listings: new, price dropped, restocked."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spreadlake.operators.ordered import Previous, with_ordered
from spreadlake.operators.state import change_flags
from spreadlake.session import materialize
from spreadlake.streaming.batches import BatchOutput, StateLog

INPUT = "retailer string, url string, at timestamp, price double, in_stock boolean"
STATE = INPUT
KEYS = ["retailer", "url"]


def _order() -> list:
    """The sighting known before the batch first, so that a late one is not new."""
    return [F.when(F.col("_anchor"), 0).otherwise(1), F.col("at"), F.xxhash64("price", "in_stock")]


def changes(sightings: DataFrame) -> DataFrame:
    """Every sighting against the one before it."""
    line = with_ordered(sightings, KEYS, _order(), _before=Previous(F.struct("price", "in_stock")))
    old_price, old_stock = F.col("_before.value.price"), F.col("_before.value.in_stock")
    flags = change_flags(F.col("_before").isNotNull(), old_price, old_stock, F.col("price"), F.col("in_stock"))
    return line.withColumns({"old_price": old_price, **flags}).drop("_before")


def step(state: StateLog, output: BatchOutput):
    def run(batch: DataFrame, batch_id: int) -> None:
        names = [*KEYS, "at", "price", "in_stock"]
        anchors = state.touched(batch_id, batch).select(*names, F.lit(True).alias("_anchor"))
        line = materialize(changes(batch.select(*names, F.lit(False).alias("_anchor")).unionByName(anchors)))
        output.put(
            batch_id,
            line.filter(~F.col("_anchor") & F.expr("is_new OR price_dropped OR restocked")).drop("_anchor"),
        )
        state.put(
            batch_id,
            line.groupBy(*KEYS).agg(
                F.max_by(F.struct("at", "price", "in_stock"), F.struct(*_order())).alias("s")
            ).select(*KEYS, "s.*"),
        )

    return run
