"""Listing screens: policy stamp, cheap screen, page confirmation, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.config import EngineConfig, FilterConfig
from spreadlake.functions import money

POLICY_COLUMNS = ("extra_cost_eur", "discount_pct", "sale_discount_pct", "buy_note")


def stamp_policy(listing: DataFrame, policy: DataFrame) -> DataFrame:
    """Put each shop's landed-cost policy on its listings. The policy has one
    row per configured shop, which is what bounds the broadcast."""
    stamp = policy.select("retailer", *POLICY_COLUMNS)
    zero = F.lit(0.0)
    kept = [c for c in listing.columns if c not in POLICY_COLUMNS]
    return listing.select(*kept).join(F.broadcast(stamp), "retailer", "left").select(
        *kept,
        *[F.coalesce(F.col(c), zero).alias(c) for c in POLICY_COLUMNS[:3]],
        "buy_note",
    )


def enabled_only(listing: DataFrame, policy: DataFrame, retailer: str | None = None) -> DataFrame:
    wanted = policy.filter("enabled")
    if retailer is not None:
        wanted = wanted.filter(F.col("retailer") == retailer)
    return listing.join(F.broadcast(wanted.select("retailer")), "retailer", "left_semi")


def landed_cost_column() -> Column:
    return money.landed_cost(
        F.col("price"), F.col("discount_pct"), F.col("sale_discount_pct"), F.col("on_sale"),
        F.col("extra_cost_eur"),
    )


def with_costs(listing: DataFrame) -> DataFrame:
    return listing.withColumns(
        {
            "landed_cost": landed_cost_column(),
            "discount_rank": money.discount_rank(F.col("price"), F.col("list_price"), F.col("on_sale")),
        }
    )


def passes_screen(filters: FilterConfig, currency: str = "EUR") -> Column:
    """Plain comparisons on stored columns, so the filter reaches the scan."""
    return (
        F.col("in_stock")
        & (F.col("style_code").isNotNull() | F.col("ean").isNotNull())
        & (F.col("price") > 0)
        & (F.col("price") <= filters.max_retail_price)
        & (F.col("currency") == currency)
    )


def cheap_screen(listing: DataFrame, filters: FilterConfig, currency: str = "EUR") -> DataFrame:
    return listing.filter(passes_screen(filters, currency))


def dropped_by_currency(listing: DataFrame, currency: str = "EUR") -> DataFrame:
    """Listings the screen drops for their currency alone, counted per shop."""
    return listing.groupBy("retailer").agg(
        F.count_if(~F.col("currency").eqNullSafe(F.lit(currency))).alias("other_currency")
    )


def newest_detail(detail: DataFrame) -> DataFrame:
    """Latest page read per listing; other columns break a tie of times."""
    names = [c for c in detail.columns if c not in ("retailer", "url")]
    row = F.struct(*names)
    return (
        detail.groupBy("retailer", "url")
        .agg(F.max_by(row, F.struct(F.col("scraped_at"), F.col("price"))).alias("_d"))
        .select("retailer", "url", "_d.*")
    )


def confirm(listing: DataFrame, detail: DataFrame, config: EngineConfig) -> DataFrame:
    """Replace grid rows by their page read. A verified listing needs none; an
    unverified one without a page read is dropped. The grid row's policy is
    carried over, the sale flags are OR-ed, the list price is kept if the page
    states none. Stock, price limit and currency are judged again."""
    page = newest_detail(detail)
    carried = {"on_sale", "list_price", *POLICY_COLUMNS}
    taken = [c for c in page.columns if c in listing.columns and c not in ("retailer", "url")]
    renamed = page.select("retailer", "url", *[F.col(c).alias(f"_page_{c}") for c in taken],
                          F.lit(True).alias("_read"))
    joined = listing.join(renamed, ["retailer", "url"], "left")
    verified = F.coalesce(F.col("price_verified"), F.lit(False))
    use_page = ~verified & F.col("_read").isNotNull()

    def pick(name: str) -> Column:
        page_value = F.col(f"_page_{name}")
        if name == "on_sale":
            page_value = F.coalesce(page_value, F.lit(False)) | F.coalesce(F.col(name), F.lit(False))
        elif name == "list_price":
            page_value = F.coalesce(page_value, F.col(name))
        elif name in carried:
            return F.col(name)
        return F.when(use_page, page_value).otherwise(F.col(name)).alias(name)

    kept = joined.filter(verified | F.col("_read").isNotNull()).select(
        *[pick(c).alias(c) if c in taken else F.col(c) for c in listing.columns]
    )
    return kept.filter(
        F.col("in_stock")
        & (F.col("price") <= config.filters.max_retail_price)
        & (F.col("currency") == config.venue.currency)
    )


def in_scan_order(listing: DataFrame, ordinal: str, limit: int | None = None) -> DataFrame:
    """Deepest discount first; equal discounts keep crawl order. With a limit
    this is a top-k, without one a range-partitioned sort."""
    ordered = listing.orderBy(F.desc("discount_rank"), F.asc(ordinal))
    return ordered.limit(limit) if limit else ordered
