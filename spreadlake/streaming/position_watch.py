"""Bid transitions of owned positions, as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.config import EngineConfig
from spreadlake.functions import money
from spreadlake.operators import watch
from spreadlake.operators.skew import lookup_join
from spreadlake.streaming.batches import BatchOutput, StateLog

INPUT = "variant_id string, at timestamp, bid double"
STATE = "variant_id string, at timestamp, bid double"
POSITIONS = "variant_id string, paid double, move double, until timestamp"

# With receipts: checks, and receipts that bear the time of the check they are for. At one
# time, checks come first.
LINES = "variant_id string, at timestamp, kind int, bid double"
EVENTS = "variant_id string, at timestamp, last_bid double, bid double, event string"
CHECK, RECEIPT = 0, 1
QUIET = (watch.NONE, watch.BASELINE)
ENDED = "watch_ended"


def event_of(last: tuple | None, bid: float | None, profit: float | None, move: float) -> str:
    """`watch.transition` of one check; `last` is the (bid, profit) known before, None at
    first. Profits are unknown without a bid."""
    if last is None:
        return watch.BASELINE
    before, earned = last
    if bid is None or before is None:
        return watch.NONE if bid is None and before is None else watch.GONE if bid is None else watch.BACK
    if abs(bid - before) >= move:
        return watch.MOVED
    loses = profit is None or profit < 0
    return watch.UNDERWATER if loses and earned is not None and earned >= 0 else watch.NONE


def priced(lines: DataFrame, positions: DataFrame, config: EngineConfig) -> DataFrame:
    """Lines of owned variants, with the profit of selling at the bid, and the terms."""
    owned = lookup_join(lines, positions, ["variant_id"], "inner")
    profit = money.sell_now(F.col("bid"), F.col("paid"), config.fees, config.vat)["profit"]
    return owned.select("variant_id", "at", "kind", "bid", profit.alias("profit"), "move", "until")


def relevant(checks: DataFrame, positions: DataFrame) -> DataFrame:
    """Checks of owned variants before their watch ends."""
    joined = lookup_join(checks, positions, ["variant_id"], "inner")
    return joined.filter(F.col("until").isNull() | (F.col("at") < F.col("until"))).drop("until")


def step(state: StateLog, output: BatchOutput, positions: DataFrame, config: EngineConfig, order: list[Column] | None = None):
    def run(batch: DataFrame, batch_id: int) -> None:
        owned = relevant(batch, positions)
        anchors = state.touched(batch_id, owned).join(positions.drop("until"), "variant_id").select(
            "variant_id", "at", "bid", "paid", "move", F.lit(True).alias("_anchor")
        )
        line = owned.select("variant_id", "at", "bid", "paid", "move", F.lit(False).alias("_anchor")).unionByName(anchors)
        # what was known before the batch comes first, so that a late check is judged against it
        placed = [F.when(F.col("_anchor"), 0).otherwise(1), *(order or [F.col("at"), F.xxhash64("bid")])]
        judged = watch.transitions(line, placed, config)
        reported = judged.filter(~F.col("_anchor") & ~F.col("event").isin(watch.NONE, watch.BASELINE))
        output.put(batch_id, reported.select("variant_id", "at", "last_bid", "bid", "event"))
        state.put(
            batch_id,
            judged.groupBy("variant_id").agg(
                F.max_by(F.struct("at", "bid"), F.struct(*placed)).alias("s")
            ).select("variant_id", "s.at", "s.bid"),
        )

    return run
