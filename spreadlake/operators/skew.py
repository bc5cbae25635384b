"""Lookup joins that survive a key holding a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spreadlake.session import materialize

# Rows of a lookup table that is sent to all tasks, at some hundred bytes each.
BROADCAST_ROWS = 500_000


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a large side to a lookup table with one row, or few, for each key.

    Spark broadcasts a lookup table under its limit. Beyond it both sides are shuffled,
    and adaptive execution cuts a partition of the large side that turns out skewed into
    pieces, each joined with the same lookup rows; inner and left joins allow that. No
    count of keys is needed beforehand, so each input is read once.
    """
    if how not in ("inner", "left"):
        raise ValueError("a skewed side can be cut in inner and left joins only")
    return left.join(right, keys, how)


def sent_if_small(side: DataFrame) -> DataFrame:
    """A lookup table, written once and counted: of few rows it is sent to all tasks, so a
    join that makes many rows of each key neither moves its large side nor is bound to as
    many tasks as there are keys. A larger one is left to `lookup_join`."""
    written = materialize(side)
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def dealt_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt out by keys before a join with a sent table multiplies them: what comes
    out is still dealt so, and joins by these keys do not move it."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys)
