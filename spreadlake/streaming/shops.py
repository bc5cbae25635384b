"""Scans of many shops, each a stream of its own that is started again after a failure."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from spreadlake.config import EngineConfig
from spreadlake.plans import jobs
from spreadlake.plans.scan import ScanInputs
from spreadlake.session import materialize

Step = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Shop:
    """A shop's landed listings and what to do with a batch of them. Without an interval in
    minutes its stream ends when the input does."""

    stream: DataFrame
    step: Step
    every: int | None = None


def scan_step(
    store: jobs.Store, given: ScanInputs, config: EngineConfig, name: str, now: Column | None = None, turn: threading.Lock | None = None,
    backfill: bool = False,
) -> Step:
    """The `foreachBatch` function of a shop: one stored scan a batch, under the shop's name
    and the batch's id, so that a batch run again replaces its own work. `turn` is shared by
    the shops of one store, whose tables take one writer at a time."""
    turn = turn or threading.Lock()

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        with turn:
            jobs.scan_job(
                store, replace(given, listing=materialize(batch)), config, F.current_timestamp() if now is None else now,
                scan_id=f"{name}-{batch_id}", backfill=backfill)

    return run


class Supervisor(StreamingQueryListener):
    """Keeps the shops' streams running. A stream that fails is started again on its
    checkpoint after `first` seconds, twice as long after each further failure in a row, up
    to `most`; a batch that goes through ends the row. The others go on meanwhile."""

    def __init__(self, spark: SparkSession, shops: dict[str, Shop], root: str, first: float = 60, most: float = 3600):
        self.spark, self.shops, self.root, self.first, self.most = spark, shops, root, first, most
        self.failures = dict.fromkeys(shops, 0)  # in a row
        self.restarts = dict.fromkeys(shops, 0)
        self.errors: dict[str, str] = {}
        self.ended = {name: threading.Event() for name in shops}
        self._names: dict[str, str] = {}
        self._running: dict[str, StreamingQuery] = {}
        self._waiting: dict[str, threading.Timer] = {}
        self._lock, self._closed = threading.RLock(), False

    def start(self) -> Supervisor:
        self.spark.streams.addListener(self)
        for name in self.shops:
            self._start(name)
        return self

    def _start(self, name: str) -> None:
        shop = self.shops[name]
        writer = shop.stream.writeStream.foreachBatch(shop.step).queryName(f"scan-{name}").option(
            "checkpointLocation", f"{self.root}/checkpoint/{name}")
        trigger = {"availableNow": True} if shop.every is None else {"processingTime": f"{shop.every} minutes"}
        with self._lock:
            if not self._closed:
                query = writer.trigger(**trigger).start()
                # a query keeps its id when it is started again on its checkpoint
                self._names[str(query.id)], self._running[name] = name, query

    def onQueryStarted(self, event) -> None:
        """Called while a start is under way: takes no lock."""

    def onQueryProgress(self, event) -> None:
        name = self._names.get(str(event.progress.id))
        if name is not None:
            self.failures[name] = 0

    def onQueryIdle(self, event) -> None:
        """Nothing new to read."""

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            name = self._names.get(str(event.id))
            if name is None or self._closed:
                return
            if event.exception is None:
                self.ended[name].set()
                return
            self.failures[name] += 1
            self.restarts[name] += 1
            self.errors[name] = event.exception
            delay = min(self.first * 2 ** (self.failures[name] - 1), self.most)
            self._waiting[name] = threading.Timer(delay, self._start, [name])
            self._waiting[name].daemon = True
            self._waiting[name].start()

    def await_end(self, timeout: float) -> bool:
        """Whether every stream came to the end of its input within so many seconds each."""
        return all([done.wait(timeout) for done in self.ended.values()])

    def stop(self) -> None:
        with self._lock:
            self._closed = True
            for timer in self._waiting.values():
                timer.cancel()
        for query in self._running.values():
            query.stop()
        self.spark.streams.removeListener(self)
