"""One scan as a single DAG: listings in; opportunities, alerts, reviews, watch
rows and statistics out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.config import EngineConfig
from spreadlake.functions.barcode import clean_gtin
from spreadlake.operators import (
    alerts, barcodes, monitor, opportunity, quotes, resolve, review, screen, sizes, state,
)
from spreadlake.operators.ordered import top_n_per_group
from spreadlake.operators.skew import lookup_join
from spreadlake.session import empty_table, materialize


@dataclass
class ScanInputs:
    """`listing` needs an `ordinal` (crawl order). Tables that do not exist yet
    may be None; quotes are the latest per variant."""

    listing: DataFrame
    policy: DataFrame
    catalog: DataFrame
    variants: DataFrame
    quotes: DataFrame
    gtin_map: DataFrame | None = None
    detail: DataFrame | None = None
    previous: DataFrame | None = None
    watch: DataFrame | None = None
    alert_state: DataFrame | None = None
    resolution: DataFrame | None = None


@dataclass
class ScanResult:
    candidates: DataFrame
    resolution: DataFrame
    opportunities: DataFrame
    alerts: DataFrame
    reviews: DataFrame
    watch: DataFrame
    out_of_stock: DataFrame
    stats: DataFrame
    barcodes: DataFrame  # to be looked up, as far as the cap goes
    seen: DataFrame  # every listing, as its page has it where that was read


QUOTE_COLUMNS = ("lowest_ask", "highest_bid", "num_asks", "num_bids", "sales_72h", "last_sale", "fetched_at")


def scan_order() -> list[Column]:
    """The order in which a scan spends its calls."""
    return [F.desc("discount_rank"), F.asc("ordinal"), F.asc("url")]


def candidates(inputs: ScanInputs, config: EngineConfig) -> DataFrame:
    """Screened listings with cost, discount rank and the change flags."""
    stamped = screen.enabled_only(screen.stamp_policy(inputs.listing, inputs.policy), inputs.policy)
    kept = screen.with_costs(screen.cheap_screen(stamped, config.filters, config.venue.currency))
    if inputs.previous is None:
        return kept.withColumn("forced", F.lit(True))
    flagged = state.listing_changes(kept, inputs.previous)
    return flagged.withColumn("forced", F.expr("is_new OR price_dropped OR restocked")).drop(
        "is_new", "price_dropped", "restocked", "old_price"
    )


def resolved_listings(cands: DataFrame, inputs: ScanInputs, config: EngineConfig, now: Column, cap: int | None):
    """(listings with `product`, new cache rows). Lookups with a valid cache row
    are not matched again; of the rest at most `cap` are."""
    need = resolve.lookups(cands)
    cached_rows = None
    if inputs.resolution is not None:
        checked = materialize(resolve.check_cache(need, inputs.resolution, now, config.venue.negative_cache_days))
        cached_rows = checked.filter("cached").select(
            *resolve.LOOKUP, "codes", "cache_key", "product", F.lit("cache").alias("method"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("found", F.lit(False)).alias("found"),
        )
        need = checked.filter("NOT cached").select(*need.columns)
    if cap is not None:
        need = _first_lookups(need, cands, cap)
    # the match feeds the listings and the cache; it is run once
    new = materialize(resolve.resolve(cands, inputs.catalog, need=need))
    every = new if cached_rows is None else new.unionByName(cached_rows)
    listed = resolve.attach(cands, every)
    if inputs.gtin_map is not None:
        listed = barcodes.match_by_barcode(listed, inputs.gtin_map, inputs.catalog)
    return listed, resolve.cache_rows(new, now)


def _first_lookups(need: DataFrame, cands: DataFrame, cap: int) -> DataFrame:
    """The lookups a scan gets to: for each shop the first `cap` in scan order. One
    that several shops ask for is charged to each of them."""
    by = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in resolve.LOOKUP]
    asked = cands.select(*resolve.LOOKUP, "retailer", "discount_rank", "ordinal", "url").alias("l").join(
        need.select(*resolve.LOOKUP).alias("r"), by, "left_semi")
    once = top_n_per_group(asked, ["retailer", *resolve.LOOKUP], scan_order(), 1)
    turn = top_n_per_group(once, ["retailer"], scan_order(), cap).select(*resolve.LOOKUP).distinct()
    return need.alias("l").join(turn.alias("r"), by, "left_semi")


def barcodes_due(asked: DataFrame, gtin_map: DataFrame, cap: int | None) -> DataFrame:
    """(gtin, retailer) of barcodes nobody has looked up: for each shop the first `cap` in
    scan order, one that several shops have is the first one's."""
    place = F.struct(*[c.alias(n) for n, c in (("rank", -F.col("discount_rank")), ("ordinal", F.col("ordinal")), ("url", F.col("url")))])
    coded = asked.select(clean_gtin(F.col("ean")).alias("gtin"), "retailer", place.alias("place")).filter("gtin IS NOT NULL")
    once = coded.groupBy("gtin").agg(F.min(F.struct("place", "retailer")).alias("first"))
    new = once.join(gtin_map.select("gtin"), "gtin", "left_anti").select("gtin", "first.retailer", "first.place")
    kept = new if cap is None else top_n_per_group(new, ["retailer"], [F.col("place"), F.col("gtin")], cap)
    return kept.select("gtin", "retailer")


def as_read(listing: DataFrame, gated: DataFrame, detail: DataFrame) -> DataFrame:
    """The listings, with price, stock and names of the pages that this scan read."""
    fields = [c for c in ("name", "price", "list_price", "in_stock", "on_sale") if c in listing.columns and c in detail.columns]
    newest = screen.newest_detail(detail).select("retailer", "url", F.struct(*fields).alias("_page"))
    read = newest.join(gated.select("retailer", "url").distinct(), ["retailer", "url"], "left_semi")
    out = lookup_join(listing, read, ["retailer", "url"])
    return out.select(*[F.coalesce(F.col(f"_page.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in listing.columns])


def affordable(sure: DataFrame, inputs: ScanInputs, config: EngineConfig, now: Column, calls: int | None) -> DataFrame:
    """Listings whose quotes may be used: fresh for every variant, or read anew
    within the call budget. A profitable-looking cached figure costs a call."""
    if calls is None:
        return sure
    ttl = quotes.with_ttl(sure.select("product_id").distinct(), inputs.watch, config) if inputs.watch is not None else (
        sure.select("product_id").distinct().withColumn("ttl_minutes", F.lit(config.venue.refresh_minutes_hot))
    )
    fresh = quotes.freshness(inputs.variants, inputs.quotes, ttl, now).select("product_id", "all_fresh")
    joined = lookup_join(sure, fresh, ["product_id"])
    needs = F.col("forced") | F.coalesce(F.col("best_upside") >= config.filters.min_profit, F.lit(False))
    stale = ~F.coalesce("all_fresh", F.lit(False))
    return quotes.within_budget(joined, needs, scan_order(), calls, stale).drop("all_fresh")


def sized_rows(listing: DataFrame, inputs: ScanInputs) -> DataFrame:
    """One row per candidate size of listings of sized products."""
    given = sizes.explode_sizes(listing)
    made = sizes.synthesised_sizes(listing, inputs.variants)
    return given.withColumn("size_pos", F.col("size_pos").cast("bigint")).unionByName(made)


def _with_quotes(rows: DataFrame, quote_table: DataFrame) -> DataFrame:
    present = [c for c in QUOTE_COLUMNS if c in quote_table.columns]
    out = lookup_join(rows, quote_table.select("variant_id", *present), ["variant_id"], "inner")
    kinds = {"num_asks": "int", "num_bids": "int", "sales_72h": "int", "last_sale": "double"}
    for name, kind in kinds.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def scan(
    inputs: ScanInputs, config: EngineConfig, now: Column,
    calls: int | None = None, resolutions: int | None = None, backfill: bool = False,
) -> ScanResult:
    """Run the scan. `calls` and `resolutions` are caps for each shop's scan, those of the
    configuration if not given; `backfill` lifts them."""
    if backfill:
        calls = resolutions = None
    else:
        calls = config.venue.calls_per_scan if calls is None else calls
        resolutions = config.venue.resolutions_per_scan if resolutions is None else resolutions
    spark = inputs.listing.sparkSession
    cands = candidates(inputs, config)
    listed, new_cache = resolved_listings(cands, inputs, config, now, resolutions)
    # the confidence split feeds two branches; the match behind it is run once, and what is looked
    # up by product goes into the same table, so that no branch writes its listings again
    known = inputs.variants.select("product_id").distinct().withColumn("_known", F.lit(True))
    keyed = listed.withColumn("product_id", F.col("product.product_id"))
    listed = materialize(quotes.assess(lookup_join(keyed, known, ["product_id"]).select(*keyed.columns, "_known"), inputs.quotes, config))
    sure, unsure = resolve.split_by_confidence(listed, config.filters.alert_min_confidence)
    low = review.rows(
        unsure, review.LOW_CONFIDENCE, now, confidence=F.col("confidence"), catalog_title=F.col("product.title")
    )
    scored = sure.filter("_known").drop("_known")
    # what the budget does not reach is not looked at, and gets no watch row
    looked_at = scored if calls is None else materialize(affordable(scored, inputs, config, now, calls))
    watch = quotes.watch_rows(looked_at, now)
    gated = quotes.upside_gate(looked_at, config)
    seen = inputs.listing
    if inputs.detail is not None:
        seen = as_read(inputs.listing, gated, inputs.detail)
        confirmed = screen.confirm(gated, inputs.detail, config).drop("landed_cost", "best_upside")
        again = quotes.assess(
            confirmed.withColumn("landed_cost", screen.landed_cost_column()), inputs.quotes, config
        )
        gated = materialize(quotes.upside_gate(again, config))

    gtin_map = inputs.gtin_map if inputs.gtin_map is not None else empty_table(
        spark, "gtin string, found boolean, product_id string, variant_id string"
    )
    single = sizes.sizeless_products(inputs.variants)
    marked = lookup_join(gated, single, ["product_id"])
    # sizeless: one product-level row, barcode and region must not contradict
    whole = barcodes.attach_gtin(marked.filter("only_variant IS NOT NULL"), "ean", gtin_map)
    whole = whole.withColumn("_verdict", barcodes.verdict(F.col("product_id")))
    whole = opportunity.region_review(whole, F.col("product.title"), F.col("name"))
    other_product = whole.filter(F.col("_verdict") == barcodes.OTHER)
    whole_gtin = review.rows(
        other_product, review.GTIN_MISMATCH, now, ean=F.col("ean"), gtin_product=F.col("gtin_product"),
        code_product=F.col("product_id"),
    )
    agreed = whole.filter(F.col("_verdict") != barcodes.OTHER)
    region = review.rows(
        agreed.filter("region_blocker IS NOT NULL"), review.REGION, now, catalog_title=F.col("product.title"),
        retail_name=F.col("name"), marker=F.col("region_blocker"),
    )
    drop = ["gtin_known", "gtin_product", "gtin_variant", "_verdict", "region_blocker", "sizes"]
    sizeless_rows = (
        agreed.filter("region_blocker IS NULL").drop(*drop)
        .withColumnRenamed("only_variant", "variant_id")
        .withColumns(
            {
                "size_label": F.lit(None).cast("string"), "us_size": F.lit(None).cast("string"),
                "size_pos": F.lit(0).cast("bigint"),
                "size_match_method": F.lit("sizeless (single variant)"),
            }
        )
    )
    # sized: barcode first, then the size chart
    per_size = sized_rows(marked.filter("only_variant IS NULL").drop("only_variant"), inputs)
    per_size = barcodes.attach_gtin(per_size, "size_ean", gtin_map).withColumn(
        "_verdict", barcodes.verdict(F.col("product_id"))
    )
    size_gtin = review.rows(
        per_size.filter(F.col("_verdict") == barcodes.OTHER), review.GTIN_MISMATCH, now,
        ean=F.col("size_ean"), size=F.col("size_label"), gtin_product=F.col("gtin_product"),
        code_product=F.col("product_id"),
    )
    by_chart = sizes.attach_variant(per_size.filter(F.col("_verdict") != barcodes.OTHER), inputs.variants)
    exact = F.col("_verdict") == barcodes.SAME
    # a barcode names its variant, and with it the size that is printed
    barcoded = inputs.variants.select(F.col("variant_id").alias("gtin_variant"), F.col("size").alias("_gtin_size"))
    # not written: conflicts ask for few of the columns, and fits go on to the quotes, which
    # leave few of the rows
    mapped = lookup_join(by_chart, barcoded, ["gtin_variant"]).withColumns(
        {
            "variant_size": F.when(exact, F.col("_gtin_size")).otherwise(F.col("variant_size")),
            "variant_id": F.when(exact, F.col("gtin_variant")).otherwise(F.col("variant_id")),
            "size_confidence": F.when(exact, F.lit(1.0)).otherwise(F.col("size_confidence")),
            "size_match_method": F.when(exact, "barcode").otherwise("size chart"),
        }
    )
    fits, conflicts = sizes.split_by_fit(mapped)
    conflict = review.rows(
        conflicts, review.SIZE_CONFLICT, now, retail_size=F.col("size_label"), us=F.col("us_size"),
        variant=F.col("variant_id"),
    )
    sized = fits.withColumn(
        "us_size", F.coalesce(F.nullif("us_size", F.lit("")), F.nullif("variant_size", F.lit("")), F.lit("?"))
    )
    both = sized.select(*sizeless_rows.columns).unionByName(sizeless_rows)
    built = opportunity.build(_with_quotes(both, inputs.quotes), config)
    flat = built.select(
        *[c for c in built.columns if c != "product"],
        *[F.col(f"product.{c}").alias(c) for c in ("style_id", "title", "url_key")],
    )
    opportunities = materialize(opportunity.collapse_unverified(flat))

    due = opportunities
    alert_state = inputs.alert_state if inputs.alert_state is not None else empty_table(
        spark, "key string, last_profit double, was_in_stock boolean"
    )
    due = alerts.due(due, alert_state, config.alerts.re_alert_delta)
    due = alerts.first_per_key(due, opportunity.report_order(due))
    gone_keys = empty_table(spark, "key string")
    if inputs.detail is not None:
        # a listing the page read left unverified is judged once more; one that
        # fails does not use up the cap, which counts alerts sent
        due, gone_keys, _ = alerts.recheck(due, screen.newest_detail(inputs.detail), config)
    capped = alerts.cap(due, config.alerts.max_per_scan, opportunity.report_order(due))
    noted = alerts.with_sibling(capped, inputs.policy, inputs.listing)
    fired = materialize(noted.withColumn("text", alerts.alert_text(config)))
    stats = monitor.scan_stats(inputs.listing, cands, opportunities, fired)
    asked = whole.select("retailer", "discount_rank", "ordinal", "url", "ean").unionByName(
        per_size.select("retailer", "discount_rank", "ordinal", "url", F.col("size_ean").alias("ean")))
    if inputs.gtin_map is not None:
        asked = asked.unionByName(listed.filter(F.col("product").isNull()).select(*asked.columns))
    due_codes = barcodes_due(asked, gtin_map, None if backfill else config.venue.gtin_lookups_per_scan)
    return ScanResult(
        candidates=cands, resolution=new_cache, opportunities=opportunities, alerts=fired,
        reviews=review.union(low, whole_gtin, region, size_gtin, conflict), watch=watch,
        out_of_stock=gone_keys, stats=stats, barcodes=due_codes, seen=seen,
    )
