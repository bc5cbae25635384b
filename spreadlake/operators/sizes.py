"""Retail size to catalog variant, without guessing.

Distinct (product, US label, EU label) combinations are matched once, by
equality of canonical size keys, and joined back to however many listings
carry them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions import size as sz
from spreadlake.functions.text import empty_to_null
from spreadlake.operators.skew import lookup_join, sent_if_small
from spreadlake.session import materialize

COMBO = ["product_id", "retail_us", "retail_eu"]


def with_retail_labels(sizes: DataFrame) -> DataFrame:
    """Route `size_label`/`size_system`/`us_size` to a US and an EU side; an
    absent side is empty text, so the columns can be join keys."""
    system, label = F.col("size_system"), F.col("size_label")
    return sizes.withColumns(
        {
            "retail_us": F.coalesce(sz.retail_us_label(system, label, F.col("us_size")), F.lit("")),
            "retail_eu": F.coalesce(sz.retail_eu_label(system, label), F.lit("")),
        }
    )


def _keyed(df: DataFrame, us: Column, eu: Column, prefix: str) -> DataFrame:
    """Add the canonical keys of both labels, and whether each label is known."""
    return df.withColumns(
        {
            f"{prefix}_us_known": F.coalesce(us != "", F.lit(False)),
            f"{prefix}_eu_known": F.coalesce(eu != "", F.lit(False)),
            f"{prefix}_us_key": sz.size_key(us),
            f"{prefix}_eu_key": sz.size_key(eu),
        }
    )


def _sides(df: DataFrame, prefix: str) -> DataFrame:
    """One row per readable label: `side` and `key` to join on."""
    both = F.array(
        F.struct(F.lit("U").alias("side"), F.col(f"{prefix}_us_key").alias("key")),
        F.struct(F.lit("E").alias("side"), F.col(f"{prefix}_eu_key").alias("key")),
    )
    rows = df.select("*", F.explode(F.filter(both, lambda k: k["key"].isNotNull())).alias("_k"))
    return rows.select(*df.columns, "_k.side", "_k.key")


def match_sizes(combos: DataFrame, variants: DataFrame) -> DataFrame:
    """Per combination: the variant, its confidence and how many fit fully.

    Several full fits are ambiguous: the first is returned at 0.5. First means
    lowest variant id, as a catalog has no other stable order.
    """
    wanted = _sides(
        _keyed(combos.select(*COMBO).distinct(), F.col("retail_us"), F.col("retail_eu"), "r"), "r"
    )
    offered = _sides(
        _keyed(
            variants.select("product_id", "variant_id", F.col("size").alias("variant_us"), "conversions"),
            F.col("variant_us"), sz.eu_conversion(F.col("conversions")), "v",
        ).drop("conversions"),
        "v",
    )
    us_decides = F.col("r_us_known") & F.col("v_us_known")
    both_eu = F.col("r_eu_known") & F.col("v_eu_known")
    eu_equal = F.coalesce(F.col("r_eu_key") == F.col("v_eu_key"), F.lit(False))
    pairs = (
        wanted.join(offered, ["product_id", "side", "key"])
        # one pair can meet under both sides; only the side that decides counts,
        # and meeting there means that its labels agree
        .filter(F.when(us_decides, F.col("side") == "U").otherwise(F.col("side") == "E"))
        .withColumn("fit", F.when(us_decides, sz.fit_given_us(both_eu, eu_equal)).otherwise(F.lit(1.0)))
    )
    first = F.min_by(F.struct("variant_id", "variant_us", "fit"), F.struct(-F.col("fit"), F.col("variant_id")))
    return pairs.groupBy(*COMBO).agg(
        F.count_if(F.col("fit") >= 1.0).alias("full_fits"), first.alias("best")
    ).select(
        *COMBO, "full_fits",
        F.col("best.variant_id").alias("variant_id"),
        F.col("best.variant_us").alias("variant_size"),
        F.when(F.col("full_fits") > 1, F.lit(0.5)).otherwise(F.col("best.fit")).alias("size_confidence"),
    )


def attach_variant(sizes: DataFrame, variants: DataFrame) -> DataFrame:
    """Add `variant_id`, `variant_size`, `size_confidence` to size rows."""
    labelled = with_retail_labels(sizes)
    # written out, the matches have a known size, which decides how they are joined
    matched = materialize(match_sizes(labelled, variants))
    out = lookup_join(labelled, matched, COMBO)
    return out.withColumn("size_confidence", F.coalesce("size_confidence", F.lit(0.0)))


def sizeless_products(variants: DataFrame) -> DataFrame:
    """Products with exactly one variant and no size on it."""
    return (
        variants.groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.trim(F.coalesce(F.col("size"), F.lit("")))).alias("any_size"),
            F.min("variant_id").alias("variant_id"),
        )
        .filter((F.col("n") == 1) & (F.col("any_size") == ""))
        .select("product_id", F.col("variant_id").alias("only_variant"))
    )


def explode_sizes(listing: DataFrame) -> DataFrame:
    """One row per size that is not known to be gone."""
    return (
        listing.select("*", F.posexplode("sizes").alias("size_pos", "_s"))
        .select(
            *[c for c in listing.columns if c != "sizes"], "size_pos",
            F.col("_s.label").alias("size_label"), F.col("_s.system").alias("size_system"),
            F.col("_s.us_size").alias("us_size"), F.col("_s.ean").alias("size_ean"),
            F.col("_s.in_stock").alias("size_in_stock"),
        )
        .filter(F.coalesce(F.col("size_in_stock"), F.lit(True)))
    )


def synthesised_sizes(listing: DataFrame, variants: DataFrame) -> DataFrame:
    """Sizes for listings whose shop publishes none: one candidate per catalog
    variant with a size, stock unknown."""
    bare = listing.filter(
        F.col("size_stock_unverified") & (F.coalesce(F.size("sizes"), F.lit(0)) <= 0)
    ).drop("sizes")
    has_eu = F.map_contains_key("conversions", F.lit("eu"))
    offered = variants.filter(F.col("size") != "").select(
        "product_id",
        F.coalesce(empty_to_null(F.try_element_at("conversions", F.lit("eu"))), F.col("size")).alias("size_label"),
        F.when(F.coalesce(has_eu, F.lit(False)), "EU").otherwise("US").alias("size_system"),
        F.col("size").alias("us_size"),
        F.lit(None).cast("string").alias("size_ean"),
        F.lit(None).cast("boolean").alias("size_in_stock"),
        F.col("variant_id").alias("_order"),
    )
    return lookup_join(bare, sent_if_small(offered), ["product_id"], "inner").withColumn("size_pos", F.xxhash64("_order").cast("bigint")).drop("_order")


def split_by_fit(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sure mappings, conflicts for review)."""
    sure = F.col("size_confidence") >= 1.0
    return sizes.filter(sure), sizes.filter(~sure & (F.col("size_confidence") > 0))
