"""The review queue: uncertain matches for a person to judge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

LOW_CONFIDENCE = "low_match_confidence"
GTIN_MISMATCH = "gtin_product_mismatch"
REGION = "region_marker_unconfirmed"
SIZE_CONFLICT = "size_mapping_conflict"


def rows(source: DataFrame, reason: str, now: Column, **detail: Column) -> DataFrame:
    """Review rows for one gate; `detail` becomes a JSON text."""
    return source.select(
        now.alias("created_at"), "retailer", "url", "style_code", F.lit(reason).alias("reason"),
        F.to_json(F.struct(*[c.alias(n) for n, c in detail.items()])).alias("detail"),
    )


def review_id() -> Column:
    """Identity of an entry: what it is about and when it was made."""
    return F.sha2(F.concat_ws("|", "url", "reason", F.unix_micros("created_at").cast("string")), 256)


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def with_status(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Add `review_id` and `resolved`; the latest event decides."""
    done = events.groupBy("review_id").agg(F.max("resolved_at").alias("resolved_at"))
    return entries.withColumn("review_id", review_id()).join(done, "review_id", "left").withColumn(
        "resolved", F.col("resolved_at").isNotNull()
    )


def add(incoming: DataFrame, open_entries: DataFrame) -> DataFrame:
    """New entries: one per (url, reason), none while one is open. The first of
    several in a batch is the one with the smallest shop and detail."""
    names = [c for c in incoming.columns if c not in ("url", "reason")]
    first = incoming.groupBy("url", "reason").agg(
        F.min_by(F.struct(*names), F.struct("created_at", "retailer", "detail")).alias("r")
    ).select("url", "reason", "r.*")
    return first.join(open_entries.select("url", "reason").distinct(), ["url", "reason"], "left_anti")


def listing(
    entries: DataFrame, reason: str | None = None, retailer: str | None = None,
    resolved: bool = False, limit: int = 50,
) -> DataFrame:
    """Newest entries first, narrowed as asked; a top-k, never a full sort."""
    out = entries.filter(F.col("resolved") == resolved)
    if reason:
        out = out.filter(F.col("reason") == reason)
    if retailer:
        out = out.filter(F.col("retailer") == retailer)
    return out.orderBy(F.desc("created_at"), F.desc("review_id")).limit(max(1, limit))


def resolve(entries: DataFrame, review_ids: DataFrame, now: Column) -> DataFrame:
    """Resolution events for the asked ids that are still open; an id that gives
    no event was unknown or already resolved."""
    return entries.filter(~F.col("resolved")).join(
        review_ids.select("review_id").distinct(), "review_id", "left_semi"
    ).select("review_id", now.alias("resolved_at"))


def counts_by_reason(entries: DataFrame) -> DataFrame:
    return (
        entries.filter(~F.col("resolved")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("reason"))
    )
