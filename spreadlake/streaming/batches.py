"""State and output of `foreachBatch` jobs, safe to run a batch again.

A stateful step here is a batch operator over the micro-batch plus the last
known row per key. That keeps the step declarative and lets the ordered
operators split a key that dominates a batch, which a per-key state processor
cannot. State is a log: each batch writes only the keys it touched; now and
then the log is folded into a full copy. Everything is written under the batch
id, so a repeated batch overwrites its own work and reads what came before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from spreadlake.session import empty_table, new_shared_path

FOLD_EVERY = 16


class StateLog:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], at: str):
        self.spark, self.path, self.schema, self.keys, self.at = spark, path, schema, keys, at

    def _complete(self, kind: str) -> list[int]:
        """Batch ids whose write finished."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return []
        done = []
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                done.append(int(name))
        return done

    def before(self, batch_id: int) -> DataFrame:
        """The newest row per key from the batches before this one."""
        full = [b for b in self._complete("full") if b < batch_id]
        base = max(full, default=-1)
        paths = [(base, f"{self.path}/full/{base}")] if full else []
        paths += [(b, f"{self.path}/delta/{b}") for b in self._complete("delta") if base < b < batch_id]
        if not paths:
            return empty_table(self.spark, self.schema)
        read = self.spark.read.schema(self.schema)
        # ranked by batch, not by time: a late row does not take a key back
        rows = reduce(DataFrame.unionByName, [read.parquet(p).withColumn("_batch", F.lit(b)) for b, p in paths])
        names = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        return rows.groupBy(*self.keys).agg(
            F.max_by(F.struct(*names), F.col("_batch")).alias("_r")
        ).select(*self.keys, "_r.*").select(*[c for c in rows.columns if c != "_batch"])

    def touched(self, batch_id: int, batch: DataFrame) -> DataFrame:
        """State of the keys in a micro-batch only."""
        return self.before(batch_id).join(batch.select(*self.keys).distinct(), self.keys, "left_semi")

    def put(self, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/delta/{batch_id}")
        if batch_id % FOLD_EVERY == FOLD_EVERY - 1:
            self.before(batch_id + 1).write.mode("overwrite").parquet(f"{self.path}/full/{batch_id}")


class BatchOutput:
    """A table whose folders are batches; a repeated batch replaces its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch_id")


def run_to_end(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that is there now, in micro-batches, then stop."""
    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def start(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str, name: str | None = None
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every)
    return (writer.queryName(name) if name else writer).start()


def start_per_shop(jobs: dict[str, tuple[DataFrame, Callable[[DataFrame, int], None], int]], root: str) -> dict[str, StreamingQuery]:
    """One query per shop, each on its own interval in minutes. A failing query
    ends alone; the others go on."""
    return {
        shop: start(stream, step, f"{root}/checkpoint/{shop}", f"{minutes} minutes", f"scan-{shop}")
        for shop, (stream, step, minutes) in jobs.items()
    }


def append_to_files(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str], every: str | None = None):
    """Append a stream to a partitioned folder."""
    writer = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).partitionBy(*partition_by)
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def scratch(spark: SparkSession, label: str) -> tuple[str, str]:
    """(output folder, checkpoint folder) in the shared place."""
    base = new_shared_path(spark, label)
    return f"{base}/out", f"{base}/checkpoint"
