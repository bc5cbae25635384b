"""Request budget, freshness, expiry of misses and liveness as streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions.times import age_seconds
from spreadlake.operators.monitor import stale_after
from spreadlake.session import materialize
from spreadlake.streaming.batches import BatchOutput, StateLog

GRAIN = "15 minutes"


def rolling_requests(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests per sliding 24 hours at 15-minute steps. Requests are counted
    into 15-minute cells first, so only cells are copied into the 96 spans they
    belong to."""
    cells = requests.withWatermark("ts", late).groupBy(F.window("ts", GRAIN)).agg(F.count(F.lit(1)).alias("n"))
    spans = cells.groupBy(F.window(F.window_time("window"), "24 hours", GRAIN)).agg(F.sum("n").alias("used"))
    return spans.select(F.col("window.start").alias("span_start"), F.col("window.end").alias("span_end"), "used")


RETRY_STATE = "cache_key string, at timestamp"


def retry_step(state: StateLog, output: BatchOutput, days: int = 3):
    """The `foreachBatch` function for lookups to try: a code that was tried is left
    alone for `days`, then may come again. State is the time of a code's last try. In
    a batch that spans several limits a code may come more than once: each round finds
    the next try of every code, so there are as many rounds as limits in the batch."""
    limit = F.make_interval(days=F.lit(int(days)))

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch.select("cache_key", "at").distinct())
        last, tries = state.touched(batch_id, rows), []
        while True:
            known = last.select("cache_key", F.col("at").alias("_last"))
            joined = rows.join(known, "cache_key", "left" if not tries else "inner")
            due = materialize(
                joined.filter(F.col("_last").isNull() | (F.col("at") > F.col("_last") + limit))
                .groupBy("cache_key").agg(F.min("at").alias("at"))
            )
            tries.append(due)
            if due.isEmpty():
                break
            last = due
        every = reduce(DataFrame.unionByName, tries)
        output.put(batch_id, every)
        state.put(batch_id, every.groupBy("cache_key").agg(F.max("at").alias("at")))

    return run


def dated_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes with the date they are filed under."""
    return quotes.withColumn("quote_date", F.to_date("fetched_at"))


def last_beats(finished: DataFrame) -> DataFrame:
    """Last finished scan per shop, as a running aggregate."""
    return finished.groupBy("retailer").agg(F.max("at").alias("last_beat"))


def liveness(beats: DataFrame, policy: DataFrame, now: Column) -> DataFrame:
    """Add `up`: the shop's last finished scan is younger than twice the fastest
    enabled interval, and at least half an hour. `policy` has a row for each shop."""
    limit = stale_after(policy).withColumn("_one", F.lit(1))
    age = age_seconds(F.col("last_beat"), now)
    return beats.withColumn("_one", F.lit(1)).join(limit, "_one").withColumn(
        "up", F.coalesce(age < F.col("stale_after_s"), F.lit(False))).drop("stale_after_s", "_one")
