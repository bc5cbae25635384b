"""Catalog products, variants and quotes from the marketplace's responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spreadlake.functions.text import empty_to_null, to_double

_HITS = """array<struct<productId:string, styleId:string, title:string, brand:string, urlKey:string,
    productType:string, productAttributes:struct<gender:string, retailPrice:double>>>"""
_VARIANTS = """array<struct<productId:string, variantId:string, variantValue:string,
    sizeChart:struct<availableConversions:array<struct<type:string,size:string>>>>>"""
_QUOTES = "array<struct<variantId:string, currencyCode:string, lowestAskAmount:string, highestBidAmount:string>>"


def catalog_products(responses: DataFrame) -> DataFrame:
    """Search hits as catalog rows; `ordinal` keeps the order of the hits."""
    hits = responses.select("ordinal", F.posexplode(F.from_json("body", _HITS)).alias("pos", "h"))
    return hits.filter("h.productId IS NOT NULL").select(
        F.col("h.productId").alias("product_id"), F.col("h.styleId").alias("style_id"), "h.title", "h.brand",
        F.col("h.urlKey").alias("url_key"), F.col("h.productAttributes.gender").alias("gender"),
        F.col("h.productAttributes.retailPrice").alias("retail_price"),
        F.col("h.productType").alias("product_type"),
        (F.col("ordinal") * F.lit(1 << 20) + F.col("pos")).alias("ordinal"),
    )


def catalog_variants(responses: DataFrame) -> DataFrame:
    """Variants with their size chart as a map; of two entries for one system
    the later counts. Needs the session's LAST_WIN map policy."""
    rows = responses.select(F.explode(F.from_json("body", _VARIANTS)).alias("v"))
    entries = F.transform(
        F.filter(
            "v.sizeChart.availableConversions",
            lambda c: (F.coalesce(c["type"], F.lit("")) != "") & (F.coalesce(c["size"], F.lit("")) != ""),
        ),
        lambda c: F.struct(F.lower(c["type"]).alias("key"), c["size"].alias("value")),
    )
    none = F.array().cast("array<struct<key:string,value:string>>")
    return rows.select(
        F.col("v.productId").alias("product_id"), F.col("v.variantId").alias("variant_id"),
        F.col("v.variantValue").alias("size"), F.lit("US").alias("size_system"),
        F.map_from_entries(F.coalesce(entries, none)).alias("conversions"),
    )


def quotes(responses: DataFrame, currency: str = "EUR") -> DataFrame:
    """Quote rows: amounts are text, unreadable ones unknown; rows without a
    variant are dropped. `product_id` and `fetched_at` come with the response."""
    rows = responses.select("product_id", "fetched_at", F.explode(F.from_json("body", _QUOTES)).alias("q"))
    return rows.filter(empty_to_null(F.col("q.variantId")).isNotNull()).select(
        "product_id", F.col("q.variantId").alias("variant_id"),
        F.coalesce(empty_to_null(F.col("q.currencyCode")), F.lit(currency)).alias("currency"),
        to_double(F.col("q.lowestAskAmount")).alias("lowest_ask"),
        to_double(F.col("q.highestBidAmount")).alias("highest_bid"),
        "fetched_at",
    )


def quote_gaps(rows: DataFrame) -> DataFrame:
    """Per product: variants quoted, and those with neither bid nor ask."""
    return rows.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("variants"),
        F.count_if(F.col("lowest_ask").isNull() & F.col("highest_bid").isNull()).alias("without_quote"),
    )
