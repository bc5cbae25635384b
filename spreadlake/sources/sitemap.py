"""Product urls from sitemaps and link pages, and the rotating backlog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spreadlake.functions import text
from spreadlake.operators.ordered import RowNumber, with_ordered
from spreadlake.operators.state import first_per_key

LOC = r"<loc>([^<]+)</loc>"


def sitemap_slugs(pages: DataFrame, capture: str) -> DataFrame:
    """Distinct slugs in order of first appearance: sitemap order `ordinal`,
    then place in the file. `capture` has one group, the slug."""
    locs = pages.select(
        "retailer", "ordinal", F.posexplode(F.regexp_extract_all("body", F.lit(LOC), F.lit(1))).alias("pos", "loc")
    )
    slugs = locs.withColumn("slug", text.first_group(F.col("loc"), capture)).filter("slug IS NOT NULL")
    return first_per_key(slugs.select("retailer", "slug", "ordinal", "pos"), ["retailer", "slug"], ["ordinal", "pos"])


def link_slugs(pages: DataFrame, capture: str) -> DataFrame:
    """Distinct linked slugs of category pages, in order of first appearance."""
    links = pages.select(
        "retailer", "ordinal", F.posexplode(F.regexp_extract_all("body", F.lit(capture), F.lit(1))).alias("pos", "slug")
    )
    return first_per_key(links, ["retailer", "slug"], ["ordinal", "pos"])


def without(slugs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Leave out pages that are no products."""
    return slugs.join(excluded.select("slug").distinct(), "slug", "left_anti")


def rotation_slice(slugs: DataFrame, offsets: DataFrame, per_scan: int) -> DataFrame:
    """The window of `per_scan` slugs from each shop's offset on, wrapping at the
    end; never more than there are. `turn` is the order of the visit."""
    numbered = with_ordered(slugs, ["retailer"], [F.col("ordinal"), F.col("pos"), F.col("slug")], _n=RowNumber())
    sizes = numbered.groupBy("retailer").agg(F.count(F.lit(1)).alias("_size"))
    # one row per shop on both sides of this join
    shops = sizes.join(offsets.select("retailer", "offset"), "retailer", "left")
    turn = F.pmod(F.col("_n") - 1 - F.coalesce(F.col("offset"), F.lit(0)), F.col("_size"))
    return (
        numbered.join(F.broadcast(shops), "retailer")
        .withColumn("turn", turn)
        .filter(F.col("turn") < F.least(F.lit(per_scan), F.col("_size")))
        .drop("_n", "_size", "offset")
    )


def next_offsets(slugs: DataFrame, offsets: DataFrame, per_scan: int) -> DataFrame:
    sizes = slugs.groupBy("retailer").agg(F.count(F.lit(1)).alias("_size"))
    start = F.coalesce(F.col("offset"), F.lit(0)) % F.col("_size")
    return sizes.join(offsets, "retailer", "left").select(
        "retailer", ((start + F.least(F.lit(per_scan), F.col("_size"))) % F.col("_size")).alias("offset")
    )


def fresh_then_rotation(fresh: DataFrame, rotation: DataFrame) -> DataFrame:
    """Fresh slugs first, then the rotation, each slug once."""
    both = fresh.select("retailer", "slug", F.lit(0).alias("part"), F.col("pos").cast("bigint").alias("place")).unionByName(
        rotation.select("retailer", "slug", F.lit(1).alias("part"), F.col("turn").cast("bigint").alias("place"))
    )
    return first_per_key(both, ["retailer", "slug"], ["part", "place"])
