"""Barcode lookups and cross-checks against the code match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions.barcode import clean_gtin
from spreadlake.operators.skew import lookup_join

SAME, OTHER, UNKNOWN = "same", "other", "unknown"


def attach_gtin(rows: DataFrame, ean: str, gtin_map: DataFrame) -> DataFrame:
    """Add `gtin_product`, `gtin_variant` and `gtin_known`. A cached miss is
    known but has no product; both read as "nothing to compare"."""
    table = gtin_map.select(
        F.col("gtin").alias("_gtin"), F.lit(True).alias("gtin_known"),
        F.when(F.col("found"), F.col("product_id")).alias("gtin_product"),
        F.when(F.col("found"), F.col("variant_id")).alias("gtin_variant"),
    )
    keyed = rows.withColumn("_gtin", clean_gtin(F.col(ean)))
    out = lookup_join(keyed, table, ["_gtin"])
    return out.withColumn("gtin_known", F.coalesce("gtin_known", F.lit(False))).drop("_gtin")


def verdict(product_id: Column) -> Column:
    """Does the barcode name the product the code named?"""
    named = F.col("gtin_product")
    return F.when(named.isNull(), UNKNOWN).when(named == product_id, SAME).otherwise(OTHER)


def match_by_barcode(listing: DataFrame, gtin_map: DataFrame, catalog: DataFrame) -> DataFrame:
    """Give listings without a code match the product their barcode names, at
    full confidence. Needs `product`, `method` and `confidence` columns."""
    fields = listing.schema["product"].dataType.fieldNames()
    products = catalog.groupBy("product_id").agg(
        F.min_by(F.struct(*fields), F.col("ordinal")).alias("_by_gtin")
    ).withColumnRenamed("product_id", "gtin_product")
    looked = attach_gtin(listing, "ean", gtin_map)
    out = lookup_join(looked, products, ["gtin_product"])
    by_code = F.col("product").isNotNull()
    by_gtin = ~by_code & F.col("_by_gtin").isNotNull()
    return out.select(
        *[c for c in listing.columns if c not in ("product", "method", "confidence")],
        F.coalesce("product", "_by_gtin").alias("product"),
        F.when(by_gtin, "barcode").otherwise(F.col("method")).alias("method"),
        F.when(by_gtin, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
    )


def lookups_due(rows: DataFrame, ean: str, gtin_map: DataFrame) -> DataFrame:
    """Distinct barcodes nobody has looked up; hits and misses are kept forever."""
    asked = rows.select(clean_gtin(F.col(ean)).alias("gtin")).filter("gtin IS NOT NULL").distinct()
    return asked.join(gtin_map.select("gtin"), "gtin", "left_anti")
