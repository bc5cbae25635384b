"""State tables without MERGE: what changes is written as a new version, then named current.

A table is a folder of versions plus a pointer folder. Rows are dealt over buckets by a hash
of their key, and a version holds the buckets that changed, as partitions; what is current is
the newest version of each bucket. A version is complete before the pointer names it, so a
lost job leaves the old state in place, and a reader that planned against a version keeps
reading it. Buckets that have been replaced for KEEP versions are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spreadlake.session import empty_table, materialize

BUCKETS, KEEP = 16, 32
BUCKET = "bucket"


class VersionedTable:
    """`keys` name the columns that tell rows apart; a larger table takes more `buckets`, a
    number that must stay as it is."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.buckets, self.keep = buckets, keep

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _listed(self, *parts: str) -> list[str]:
        where = self._at(*parts)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _versions(self) -> list[int]:
        return sorted(int(name) for name in self._listed("_current"))

    def version(self) -> int:
        """Number of the current version, 0 before the first."""
        return max(self._versions(), default=0)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _newest(self, upto: int) -> dict[int, int]:
        """The version that holds each bucket; there are as many version folders as buckets,
        and those kept, at most."""
        out: dict[int, int] = {}
        committed = {v for v in self._versions() if v <= upto}
        folders = {int(name[1:]) for name in self._listed() if name.startswith("v")}
        for v in sorted(committed & folders):
            for name in self._listed(f"v{v}"):
                if name.startswith(f"{BUCKET}="):
                    out[int(name.partition("=")[2])] = v
        return out

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows as of a version, of some buckets only if so asked."""
        newest = self._newest(self.version() if version is None else version)
        paths = [f"{self.path}/v{v}/{BUCKET}={b}" for b, v in sorted(newest.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else empty_table(self.spark, self.schema)

    def replace(self, rows: DataFrame) -> int:
        """All rows anew."""
        return self._write(rows, list(range(self.buckets)))

    def put(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """`merge(old, rows)` in place of the buckets that `rows` have a key in; no other
        bucket is read or written."""
        rows = materialize(rows)
        touched = [r[0] for r in rows.select(self.bucket()).distinct().collect()]  # `buckets` at most
        return self._write(merge(self.read(only=touched), rows), touched) if touched else self.version()

    def _write(self, rows: DataFrame, touched: list[int]) -> int:
        """Write the next version and point to it. The pointer is an empty file named after
        the version; creating it fails if another writer was first."""
        number = self.version() + 1
        names = empty_table(self.spark, self.schema).columns
        dealt = rows.select(*names).withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/v{number}")
        fs = self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in touched:  # a bucket without rows is an empty folder
            fs.mkdirs(self._at(f"v{number}", f"{BUCKET}={b}"))
        fs.mkdirs(self._at("_current"))
        if not fs.createNewFile(self._at("_current", str(number))):
            raise RuntimeError(f"version {number} of {self.path} was written by another job")
        self._remove_old(fs, number)
        return number

    def _remove_old(self, fs, number: int) -> None:
        """Remove what the oldest version that is kept does not show any more."""
        oldest = number - self.keep
        if oldest < 1:
            return
        newest = self._newest(oldest)
        for v in (int(name[1:]) for name in self._listed() if name.startswith("v")):
            if v < oldest and v not in newest.values():
                fs.delete(self._at(f"v{v}"), True)
            elif v < oldest:
                for name in self._listed(f"v{v}"):
                    if name.startswith(f"{BUCKET}=") and newest.get(int(name.partition("=")[2])) != v:
                        fs.delete(self._at(f"v{v}", name), True)


def append(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def keep_latest(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Keyed upsert: the newest row per key, a tie going to the new rows. One
    aggregation over the union, combined before the shuffle."""
    names = [c for c in old.columns if c not in keys]
    both = old.select(*old.columns, F.lit(0).alias("_new")).unionByName(
        new.select(*old.columns, F.lit(1).alias("_new"))
    )
    return both.groupBy(*keys).agg(
        F.max_by(F.struct(*names), F.struct(at, "_new")).alias("_r")
    ).select(*keys, "_r.*").select(*old.columns)


def drop_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def first_per_key(rows: DataFrame, keys: list[str], position: list[str], keep_last: bool = False) -> DataFrame:
    """Keep the first (or last) row of each key by source position."""
    names = [c for c in rows.columns if c not in keys]
    pick = F.max_by if keep_last else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*names), F.struct(*position)).alias("_r")).select(
        *keys, "_r.*"
    ).select(*rows.columns)


def change_flags(seen: Column, old_price: Column, old_stock: Column, price: Column, in_stock: Column) -> dict[str, Column]:
    return {
        "is_new": ~seen,
        "price_dropped": F.coalesce(seen & (price < old_price - 0.01), F.lit(False)),
        "restocked": F.coalesce(seen & ~old_stock & in_stock, F.lit(False)),
    }


def listing_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """New listings with `is_new`, `price_dropped`, `restocked`, `old_price`."""
    before = old.select(
        "retailer", "url", F.col("price").alias("old_price"), F.col("in_stock").alias("_stock"), F.lit(True).alias("_seen")
    )
    joined = new.join(before, ["retailer", "url"], "left")
    flags = change_flags(
        F.coalesce("_seen", F.lit(False)), F.col("old_price"), F.col("_stock"), F.col("price"), F.col("in_stock")
    )
    return joined.withColumns(flags).drop("_stock", "_seen")


def changed_keys(changes: DataFrame) -> DataFrame:
    """Listings whose quotes must be read anew this scan."""
    return changes.filter("is_new OR price_dropped OR restocked").select("retailer", "url").distinct()


def merge_listings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Listing upsert that keeps `first_seen`; both sides are one row per
    (retailer, url) and carry `first_seen` and `last_seen`."""
    names = [c for c in old.columns if c not in ("retailer", "url", "first_seen")]
    o = old.select("retailer", "url", F.struct(*old.columns).alias("o"))
    n = new.select("retailer", "url", F.struct(*old.columns).alias("n"))
    both = o.join(n, ["retailer", "url"], "full_outer")
    return both.select(
        "retailer", "url",
        *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in names],
        F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"),
    ).select(*old.columns)
