"""Ordered (window-like) columns that never put one group into one task.

`row_number`, `lag` and running sums over `partitionBy(key)` send every row of a
key to a single task, and one key may hold a third of all rows. Here the rows
are range-partitioned by key *and* order, so a large key is cut into segments;
the window runs inside each segment and a carry from the earlier segments of the
same key is added afterwards. Only the first key of a segment can have begun in
an earlier one, so the carry table has at most one row per segment: that bound
is what allows it to be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from spreadlake.session import materialize

SEGMENT = "_segment"
_TAIL = "_tail"
_PLACE = "_place"


@dataclass(frozen=True)
class RowNumber:
    """Position inside the key, from 1."""


@dataclass(frozen=True)
class RunningSum:
    """Sum of the value up to and including the row."""

    value: Column


@dataclass(frozen=True)
class Previous:
    """One-field struct with the value of the row before; NULL on the first row,
    so that "no earlier row" differs from "the earlier value is unknown"."""

    value: Column


@dataclass(frozen=True)
class LastKnown:
    """Latest non-NULL value up to and including the row."""

    value: Column


@dataclass(frozen=True)
class RowsSince:
    """Rows of the key after the last one where the condition held, that one not counted;
    all rows so far where it never did. NULL does not hold."""

    reset: Column


def _inside(spec, window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    if isinstance(spec, RowsSince):
        return F.col(_PLACE) - F.coalesce(F.last(F.when(spec.reset, F.col(_PLACE)), ignorenulls=True).over(upto), F.lit(0))
    if isinstance(spec, RowNumber):
        return F.row_number().over(window).cast("bigint")
    if isinstance(spec, RunningSum):
        return F.sum(spec.value).over(upto)
    if isinstance(spec, Previous):
        return F.lag(F.struct(spec.value.alias("value"))).over(window)
    return F.last(spec.value, ignorenulls=True).over(upto)


def _carried(spec, name: str, earlier) -> Column:
    if isinstance(spec, (RowNumber, RunningSum)):
        return F.sum(F.col(name)).over(earlier)
    if isinstance(spec, RowsSince):
        # what earlier segments add up to, but for what lies before the last that had a reset
        before = F.last(F.when(~F.col(f"_open_{name}"), F.col(f"_upto_{name}") - F.col(name)), ignorenulls=True)
        return F.sum(F.col(name)).over(earlier) - F.coalesce(before.over(earlier), F.lit(0))
    if isinstance(spec, Previous):
        return F.last(F.col(f"_own_{name}")).over(earlier)
    return F.last(F.col(name), ignorenulls=True).over(earlier)


def with_ordered(df: DataFrame, keys: list[str], order: list[Column], **specs) -> DataFrame:
    """Add one column per spec. `order` must be a total order inside a key."""
    # without a number of its own the shuffle is sized by the session, and adaptive
    # execution may merge neighbouring ranges that turn out small
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    window = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    previous = {n: s for n, s in specs.items() if isinstance(s, Previous)}
    since = {n: s for n, s in specs.items() if isinstance(s, RowsSince)}
    # of the same window, so it costs no exchange of its own
    place = {_PLACE: F.row_number().over(window).cast("bigint")} if since else {}
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    local = materialize(
        ranged.withColumn(SEGMENT, F.spark_partition_id()).withColumns(place).select(
            *[F.col(c) for c in df.columns], SEGMENT,
            *[(~F.coalesce(F.bool_or(s.reset).over(upto), F.lit(False))).alias(f"_open_{n}") for n, s in since.items()],
            *[_inside(s, window).alias(n) for n, s in specs.items()],
            *[F.struct(s.value.alias("value")).alias(f"_own_{n}") for n, s in previous.items()],
            F.lead(F.lit(True), 1, False).over(window).alias(_TAIL),
        )
    )
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, 0)
    carry = (
        local.filter(~F.col(_TAIL))
        .withColumns({f"_upto_{n}": F.sum(n).over(through) for n in since})
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col(SEGMENT).alias("_carry_segment"),
            *[_carried(s, n, earlier).alias(f"_carry_{n}") for n, s in specs.items()],
            F.count(F.lit(1)).over(earlier).alias("_behind"),
        )
        .filter(F.col("_behind") > 0)
    )
    same = F.col(SEGMENT) == F.col("_carry_segment")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(F.broadcast(carry), same, "left")

    def total(name: str, spec) -> Column:
        inside, before = F.col(name), F.col(f"_carry_{name}")
        if isinstance(spec, RowNumber):
            return inside + F.coalesce(before, F.lit(0))
        if isinstance(spec, RowsSince):
            return inside + F.when(F.col(f"_open_{name}"), F.coalesce(before, F.lit(0))).otherwise(F.lit(0))
        if isinstance(spec, RunningSum):
            return F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(inside + before)
        return F.coalesce(inside, before)

    return joined.select(
        *[F.col(c) for c in df.columns], *[total(n, s).alias(n) for n, s in specs.items()]
    )


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None, salts: int = 64
) -> DataFrame:
    """The first `n` rows of each key, exactly.

    Each of `salts` slices of a key first keeps its own first `n`, so the final
    ranking of a key sees at most `salts * n` rows however large the key is.
    """
    name = rank or "_rank"
    slices = df.withColumn("_slice", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(salts)))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    kept = slices.withColumn(name, F.row_number().over(local)).filter(F.col(name) <= n).drop(name, "_slice")
    final = Window.partitionBy(*keys).orderBy(*order)
    out = kept.withColumn(name, F.row_number().over(final)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def rolling_count(df: DataFrame, time: str, seconds: int, out: str) -> DataFrame:
    """Events in the `seconds` up to and including each row's time.

    A range window without a key would be a single task. Instead the count is
    the difference of two running totals over distinct times: up to the time
    itself, and up to just before the start of its span.
    """
    at = df.groupBy(F.col(time).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    spots = at.select(
        "_t",
        F.explode(
            F.array(
                F.struct(F.col("_t").alias("pos"), F.lit(1).alias("side"), F.col("_n").alias("n")),
                F.struct(
                    (F.col("_t") - F.expr(f"INTERVAL {int(seconds)} SECONDS")).alias("pos"),
                    F.lit(0).alias("side"),
                    F.lit(0).cast("bigint").alias("n"),
                ),
            )
        ).alias("_s"),
    ).select("_t", F.col("_s.pos").alias("_pos"), F.col("_s.side").alias("_side"), F.col("_s.n").alias("_n"))
    total = with_ordered(
        spots, [], [F.col("_pos"), F.col("_side"), F.col("_t")], _total=RunningSum(F.col("_n"))
    )
    per_time = total.groupBy("_t").agg(
        (
            F.max(F.when(F.col("_side") == 1, F.col("_total")))
            - F.max(F.when(F.col("_side") == 0, F.col("_total")))
        ).alias(out)
    )
    return df.join(per_time, df[time] == per_time["_t"], "left").drop("_t")
