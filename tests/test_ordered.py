"""Ordered columns, top-n, rolling counts and salted joins against plain ones."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window, functions as F

from spreadlake.operators.ordered import LastKnown, Previous, RowNumber, RowsSince, RunningSum, rolling_count, top_n_per_group, with_ordered
from spreadlake.operators.skew import lookup_join


@pytest.fixture(scope="module", autouse=True)
def small_ranges(spark):
    """Keep the ranges of this small input apart, or there would be one segment."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def rows(spark):
    """Key "hot" holds a third of the rows, one key is NULL, some values too."""
    rnd = random.Random(3)
    data = [
        (i, rnd.choice(["hot"] * 3 + [f"k{j}" for j in range(5)] + [None]), rnd.randint(0, 40), rnd.choice([None, 1, 2, 5]))
        for i in range(900)
    ]
    return spark.createDataFrame(data, "id int, key string, at int, value int")


def test_ordered_columns_equal_windows(rows):
    order = [F.col("at"), F.col("id")]
    got = with_ordered(
        rows, ["key"], order, n=RowNumber(), total=RunningSum(F.col("value")), before=Previous(F.col("value")),
        known=LastKnown(F.col("value")),
    )
    w = Window.partitionBy("key").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*", F.row_number().over(w).cast("bigint").alias("n"), F.sum("value").over(upto).alias("total"),
        F.lag(F.struct(F.col("value").alias("value"))).over(w).alias("before"), F.last("value", True).over(upto).alias("known"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("condition", ["value = 1", "value IS NULL", "id % 97 = 5", "id < 0", "true"])
def test_rows_since_equal_a_plain_count(rows, condition):
    """Resets in every segment, in a few, in none; a NULL condition does not hold."""
    got = with_ordered(rows, ["key"], [F.col("at"), F.col("id")], n=RowsSince(F.expr(condition))).select("id", "n").collect()
    at, want = {}, {}
    for r in sorted(rows.withColumn("reset", F.expr(condition)).collect(), key=lambda r: (r["at"], r.id)):
        at[r.key] = 0 if r.reset else at.get(r.key, 0) + 1
        want[r.id] = at[r.key]
    assert {r.id: r.n for r in got} == want


def test_descending_order_and_no_key(rows):
    order = [F.desc("at"), F.asc("id")]
    got = with_ordered(rows, [], order, n=RowNumber()).select("id", "n")
    want = rows.select("id", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_large_key_is_split(spark, rows):
    from spreadlake.operators import ordered

    seen = {}
    original = ordered.materialize

    def spy(df):
        out = original(df)
        seen["segments"] = out.filter("key = 'hot'").select(ordered.SEGMENT).distinct().count()
        return out

    ordered.materialize = spy
    try:
        with_ordered(rows, ["key"], [F.col("at"), F.col("id")], n=RowNumber())
    finally:
        ordered.materialize = original
    assert seen["segments"] > 1


def test_top_n(rows):
    order = [F.col("at"), F.col("id")]
    got = top_n_per_group(rows.repartition(6), ["key"], order, 4, rank="place", salts=3)
    w = Window.partitionBy("key").orderBy(*order)
    want = rows.withColumn("place", F.row_number().over(w)).filter("place <= 4")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rolling_count(spark):
    rnd = random.Random(5)
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    times = [start + timedelta(seconds=rnd.choice([0, 0, 3600, rnd.randint(0, 400_000)])) for _ in range(300)]
    times += [start + timedelta(hours=24), start + timedelta(hours=24, microseconds=1)]
    df = spark.createDataFrame(list(enumerate(times)), "id int, ts timestamp")
    got = {r.id: r.n for r in rolling_count(df, "ts", 86400, "n").collect()}
    day = timedelta(days=1)
    assert got == {i: sum(1 for u in times if t - day <= u <= t) for i, t in enumerate(times)}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_hot_key_of_a_shuffled_lookup_is_cut(spark, how):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    left = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 != 0, F.lit(7)).otherwise(F.col("id")).alias("key"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    right = spark.range(0, 60_000, 1, 4).select(F.col("id").alias("key"), (F.col("id") * 2).alias("tag"))
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        joined = lookup_join(left, right, ["key"], how)
        assert joined.filter("tag = key * 2").count() == 60_000
        joined = lookup_join(left, right, ["key"], how)
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_a_join_that_cannot_be_cut_is_refused(spark):
    with pytest.raises(ValueError):
        lookup_join(spark.range(1), spark.range(1), ["id"], "full")
