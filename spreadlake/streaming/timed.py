"""Stateful streams with timers: what falls due by itself, without a new row.

Each job keeps a small state for each key and an event-time timer. Rows of a micro-batch are
applied in order of time; what would have fallen due before a row is told before the row is
applied, so that the result does not depend on where a batch was cut. The timer is for keys
that stay quiet: it fires once the watermark has passed it. State and timers live in the
state store under the query's checkpoint and are restored from it when an executor is lost.

A key's rows of one micro-batch are sorted together; `maxFilesPerTrigger` of the source
bounds them. Rows older than the watermark are left out by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spreadlake.config import EngineConfig
from spreadlake.streaming import cadence, position_watch

STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
TIMER_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timer_store(spark: SparkSession):
    """Timers need the RocksDB store; a query keeps the store it was started with."""
    before = spark.conf.get(STORE_CONF, None)
    spark.conf.set(STORE_CONF, TIMER_STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE_CONF)
        else:
            spark.conf.set(STORE_CONF, before)


def start(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write a timed stream to a folder; without an interval, as far as the input goes."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    with timer_store(stream.sparkSession):
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _micros(at) -> int:
    return pd.Timestamp(at).value // 1000


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> list[dict]:
    """A key's rows of a batch, by time; unknown values are None."""
    every = pd.concat(list(frames), ignore_index=True)
    every["at"] = [_micros(t) for t in every["at"]]
    every = every.sort_values(order, kind="stable", na_position="first")
    return every.astype(object).where(every.notna(), None).to_dict("records")


def _frame(rows: list[tuple], columns: list[str], times: tuple[str, ...]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in times:
        out[c] = pd.to_datetime(out[c], unit="us")
    return out


class Timed(StatefulProcessor):
    """One state row and at most one timer for each key."""

    STATE = ""  # without the timer's own column
    OUT: list[str] = []
    TIMES: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE + ", timer long")

    def apply(self, key: str, state: tuple | None, rows: list[dict]) -> tuple[tuple | None, list[tuple], int | None]:
        """(new state, what to tell, when it falls due by itself) after a batch's rows."""
        raise NotImplementedError

    def expire(self, key: str, state: tuple) -> tuple[tuple | None, list[tuple]]:
        """(new state, what to tell) when the timer fires."""
        raise NotImplementedError

    ORDER = ["at"]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        state, told, due = self.apply(key[0], None if held is None else held[:-1], _rows(rows, self.ORDER))
        # timers are in milliseconds: the first one that is not before the time
        timer = None if due is None else -(-due // 1000)
        if held is not None and held[-1] is not None and held[-1] != timer:
            self.handle.deleteTimer(held[-1])
        if timer is not None:
            self.handle.registerTimer(timer)
        if state is not None:
            self.state.update((*state, timer))
        elif held is not None:
            self.state.clear()
        if told:
            yield _frame(told, self.OUT, self.TIMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        if held is None or held[-1] != expiredTimerInfo.getExpiryTimeInMs():
            return
        state, told = self.expire(key[0], held[:-1])
        if state is None:
            self.state.clear()
        else:
            self.state.update((*state, None))
        if told:
            yield _frame(told, self.OUT, self.TIMES)

    def close(self) -> None:
        pass


# -- misses that expire ---------------------------------------------------------

MISSES = "cache_key string, at timestamp"
EXPIRED = "cache_key string, tried_at timestamp, due_at timestamp"


class Misses(Timed):
    STATE, OUT, TIMES = "tried long", ["cache_key", "tried_at", "due_at"], ("tried_at", "due_at")

    def __init__(self, days: int):
        self.limit = days * 86_400_000_000

    def apply(self, key, state, rows):
        tried, told = (state or (None,))[0], []
        for row in rows:
            if tried is not None and row["at"] > tried + self.limit:
                told.append((key, tried, tried + self.limit))
                tried = row["at"]
            tried = row["at"] if tried is None else max(tried, row["at"])
        return (tried,), told, tried + self.limit

    def expire(self, key, state):
        return None, [(key, state[0], state[0] + self.limit)]


def expired_misses(misses: DataFrame, days: int, late: str = "1 hour") -> DataFrame:
    """A code that was looked up in vain falls due for another try `days` after its last
    one, seen again or not."""
    return misses.withWatermark("at", late).groupBy("cache_key").transformWithStateInPandas(
        Misses(days), EXPIRED, "append", "eventTime")


# -- refresh cadence --------------------------------------------------------------

class Cadence(Timed):
    STATE = "best double, assessed boolean, waiting boolean, fetched map<string, long>"
    OUT, TIMES, ORDER = ["product_id", "due_at", "ttl_minutes"], ("due_at",), ["at", "kind"]

    def __init__(self, config: EngineConfig):
        self.config = config

    def apply(self, key, state, rows):
        best, assessed, waiting, fetched = state or (None, False, False, {})
        fetched, told = dict(fetched), []
        for row in rows:
            minutes, due = cadence.due_time(self.config, assessed, best, fetched)
            if fetched and not waiting and row["at"] > due:
                told.append((key, due, minutes))
                waiting = True
            if row["kind"] == cadence.WATCH:
                best, assessed = row["best_profit"], True
            elif row["kind"] == cadence.VARIANT:
                fetched.setdefault(row["variant_id"], cadence.NEVER)
            else:
                fetched[row["variant_id"]] = max(fetched.get(row["variant_id"], cadence.NEVER), row["at"])
            minutes, due = cadence.due_time(self.config, assessed, best, fetched)
            if not fetched or due >= row["at"]:
                waiting = False
            elif not waiting:
                told.append((key, row["at"], minutes))
                waiting = True
        return (best, assessed, waiting, fetched), told, None if waiting or not fetched else due

    def expire(self, key, state):
        best, assessed, waiting, fetched = state
        minutes, due = cadence.due_time(self.config, assessed, best, fetched)
        return (best, assessed, True, fetched), [(key, due, minutes)]


def due_products(lines: DataFrame, config: EngineConfig, late: str = "1 hour") -> DataFrame:
    """When each product falls due for reading: as soon as the oldest quote of its variants
    is past the limit its watch row asks for. It is told once, until all are fresh again.
    Lines are those of `cadence.LINES`."""
    return lines.withWatermark("at", late).groupBy("product_id").transformWithStateInPandas(
        Cadence(config), cadence.DUE, "append", "eventTime")


# -- watched positions ------------------------------------------------------------

def _known(value: float) -> float | None:
    return None if value != value else value


class Watched(Timed):
    # `open`: bid and profit of what was told and not confirmed yet, by the time of the check;
    # keys of a stored map are strings, and unknown values NaN
    STATE = "known boolean, bid double, profit double, until long, open map<string, array<double>>"
    OUT, TIMES, ORDER = ["variant_id", "at", "last_bid", "bid", "event"], ("at",), ["at", "kind", "bid"]

    def apply(self, key, state, rows):
        known, bid, profit, until, stored = state or (False, None, None, None, {})
        last, told = (bid, profit) if known else None, []
        open_ = {int(t): tuple(map(_known, b)) for t, b in stored.items()}
        for row in rows:
            until = None if row["until"] is None else _micros(row["until"])
            if until is not None and row["at"] >= until:
                continue
            if row["kind"] == position_watch.RECEIPT:
                # what was told is the state from here on; older reports are past
                if row["at"] in open_:
                    last = open_[row["at"]]
                    open_ = {t: b for t, b in open_.items() if t > row["at"]}
                continue
            event = position_watch.event_of(last, row["bid"], row["profit"], row["move"])
            if event in position_watch.QUIET:
                last = (row["bid"], row["profit"])
            else:
                told.append((key, row["at"], last[0], row["bid"], event))
                open_[row["at"]] = (row["bid"], row["profit"])
        stored = {str(t): [float("nan") if x is None else x for x in r] for t, r in open_.items()}
        return (last is not None, *(last or (None, None)), until, stored), told, until

    def expire(self, key, state):
        return None, [(key, state[3], state[1], None, position_watch.ENDED)]


def watched_positions(lines: DataFrame, positions: DataFrame, config: EngineConfig, late: str) -> DataFrame:
    """Bid transitions of positions. The last bid moves when nothing is to be told, or when a
    receipt says that what was told arrived; a report that got lost comes up again with the
    next check. A position's end is told at its time. Lines are those of
    `position_watch.LINES`, late ones judged against what was known before their batch."""
    timed = position_watch.priced(lines, positions, config).withWatermark("at", late)
    return timed.groupBy("variant_id").transformWithStateInPandas(Watched(), position_watch.EVENTS, "append", "eventTime")
