"""Helpers the operators share: reading tables, narrowing documents, numbering runs."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spreadlake.session import configure, materialize

# Python words are split at exactly the characters Arrow calls ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

# Text handled at once inside a Python task; a longer single text is one slice.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings the results depend on, and this package on the path of Python
    workers that a driver on this machine starts (a cluster gets it with the job)."""
    root = str(Path(__file__).resolve().parents[2])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [path, root]))
    # every cut of a lineage is a written table, so the shuffles behind it can go at once
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    # what a Python task and its JVM side hold of the texts at once
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return configure(spark)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, ...) of every row that has an id; other columns, whatever
    their names, are left behind here so that they cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[F.col(c) for c in more]).filter(F.col("doc_id").isNotNull())


# Rows of a side that is sent to all tasks, at a few dozen bytes each.
BROADCAST_ROWS = 500_000


def checked(side: DataFrame) -> DataFrame:
    """Broadcast a written side of few rows, counted first; a larger one is left to a
    shuffle."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of `docs` that have an id, but for those whose id is in `dropped`. The
    texts stay where they are as long as few are dropped."""
    ids = materialize(dropped.select("doc_id").distinct())
    return docs.filter(F.col("doc_id").isNotNull()).join(checked(ids), "doc_id", "left_anti").select(*docs.columns)


def crc_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def tables_of(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again in slices of at most `limit` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of rows a task returns, from the same DDL Spark is given."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(),
             "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([pa.field(n, kinds[k]) for n, k in (part.split() for part in ddl.split(", "))])


_HELD: dict = {}


def held(key, build):
    """The one object a Python worker keeps between its tasks, such as a tokenizer or a
    model; asking for another drops it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def give_back() -> None:
    """Drop what the worker holds, and give memory it has freed, now or in stages before,
    back to the system; allocators keep it otherwise, and a worker lives on between stages."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def spans_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes laid end to end: each row's group, and its place there."""
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - first[group]
