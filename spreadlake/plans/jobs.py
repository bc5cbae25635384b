"""The jobs a user runs, each a composition of operators over state tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spreadlake import schemas
from spreadlake.config import EngineConfig
from spreadlake.operators import alerts, monitor, report, review, sales, state
from spreadlake.operators.state import VersionedTable, append
from spreadlake.plans.scan import ScanInputs, ScanResult, scan
from spreadlake.session import empty_table, materialize


OUTBOX = """
    key string, retailer string, url string, size_label string, gate_profit double, in_stock boolean,
    reason string, text string, made_at timestamp, scan_id string
"""


@dataclass
class Store:
    """The state tables under one folder."""

    spark: SparkSession
    root: str

    def table(self, name: str, schema: str, *keys: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}", schema, keys)

    @property
    def resolution(self) -> VersionedTable:
        return self.table("resolution", schemas.RESOLUTION, "cache_key")

    @property
    def variants(self) -> VersionedTable:
        return self.table("catalog_variant", schemas.CATALOG_VARIANT, "product_id", "variant_id")

    @property
    def watch(self) -> VersionedTable:
        return self.table("watch", schemas.WATCH, "product_id")

    @property
    def gtin_map(self) -> VersionedTable:
        return self.table("gtin_map", schemas.GTIN_MAP, "gtin")

    @property
    def alerts(self) -> VersionedTable:
        return self.table("alert_state", schemas.ALERT_STATE, "key")

    @property
    def listing(self) -> VersionedTable:
        return self.table("listing", schemas.LISTING_STATE, "retailer", "url")

    def put_scan(self, name: str, scan_id: str, rows: DataFrame) -> None:
        """What one scan adds to a log; the same scan run again replaces it."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/scan_id={scan_id}")

    def log(self, name: str, schema: str) -> DataFrame:
        """An append-only table; empty before its first row."""
        path = f"{self.root}/{name}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return empty_table(self.spark, schema)
        return self.spark.read.schema(schema).parquet(path)


def put_resolution(store: Store, rows: DataFrame) -> int:
    return store.resolution.put(rows, lambda old, new: state.keep_latest(old, new, ["cache_key"], "resolved_at"))


def drop_resolution(store: Store, keys: DataFrame) -> int:
    return store.resolution.put(keys.select("cache_key"), lambda old, gone: state.drop_keys(old, gone, ["cache_key"]))


def put_variants(store: Store, rows: DataFrame) -> int:
    """Variant upsert; the incoming row replaces the stored one."""
    keys = ["product_id", "variant_id"]

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        # a map column cannot be compared, so the choice among equals is by its text
        fresh = new.groupBy(*keys).agg(
            F.max_by(F.struct("size", "size_system", "conversions"), F.coalesce(F.to_json("conversions"), F.lit(""))).alias("r")
        ).select(*keys, "r.*")
        return state.drop_keys(old, new, keys).unionByName(fresh)

    return store.variants.put(rows, merge)


def put_watch(store: Store, rows: DataFrame) -> int:
    return store.watch.put(rows, lambda old, new: state.keep_latest(old, new, ["product_id"], "checked_at"))


def put_gtins(store: Store, rows: DataFrame) -> int:
    return store.gtin_map.put(rows, lambda old, new: state.keep_latest(old, new, ["gtin"], "looked_up_at"))


def put_listings(store: Store, seen: DataFrame, now: Column) -> int:
    """Listing upsert: what a scan saw, the first of a url in crawl order, with the time each
    listing was first seen."""
    table = store.listing
    names = [c for c in empty_table(store.spark, table.schema).columns if c not in ("first_seen", "last_seen")]
    place = [c for c in ("ordinal",) if c in seen.columns]
    first = state.first_per_key(seen.select(*dict.fromkeys([*names, *place])), ["retailer", "url"], [*place, "price"])
    rows = first.select(*names).withColumns({"first_seen": now, "last_seen": now})
    return table.put(rows, state.merge_listings)


def put_quotes(store: Store, rows: DataFrame) -> None:
    """Quotes are appended; the latest one is derived by an aggregate."""
    dated = rows.withColumn("quote_date", F.to_date("fetched_at"))
    append(dated, f"{store.root}/quote_history", ("quote_date",))


def record_alerts(store: Store, delivered: DataFrame, now: Column) -> int:
    return store.alerts.put(delivered, lambda old, new: alerts.record(old, new, now))


def mark_out_of_stock(store: Store, gone: DataFrame) -> int:
    return store.alerts.put(gone, alerts.mark_out_of_stock)


def reviews(store: Store) -> DataFrame:
    entries = store.log("review_queue", schemas.REVIEW)
    return review.with_status(entries, store.log("review_events", schemas.REVIEW_EVENT))


def add_reviews(store: Store, incoming: DataFrame) -> None:
    fresh = review.add(incoming, reviews(store).filter(~F.col("resolved")))
    append(fresh.select("created_at", "retailer", "url", "style_code", "reason", "detail"), f"{store.root}/review_queue")


def resolve_reviews(store: Store, ids: DataFrame, now: Column) -> DataFrame:
    """Resolve open entries; the ids that changed are returned."""
    events = review.resolve(reviews(store), ids, now)
    append(events, f"{store.root}/review_events")
    return store.log("review_events", schemas.REVIEW_EVENT).join(ids, "review_id", "left_semi")


def log_scan(store: Store, rows: DataFrame, scan_id: str) -> None:
    store.put_scan("scan_log", scan_id, rows.select(
        "started_at", "retailer", "products_seen", "candidates", "opportunities", "alerts_sent"))


def record_sales(store: Store, rows: DataFrame, config: EngineConfig) -> None:
    names = empty_table(store.spark, schemas.SALE).columns
    append(sales.with_prediction(rows, config).select(*names), f"{store.root}/sales")


def sold_report(store: Store) -> tuple[DataFrame, DataFrame]:
    """(each sale with its outcome, mean gap to the model)."""
    every = store.log("sales", schemas.SALE)
    return sales.outcomes(sales.by_date(every)), sales.calibration(every)


STARTS = "state string, version int, scan_id string"


def _started_from(store: Store, scan_id: str) -> dict[str, int]:
    """The versions of the state a scan starts from; those of its first run if it is run
    again, so that it does not judge by what it left itself."""
    tables = {n: getattr(store, n) for n in ("resolution", "watch", "alerts", "gtin_map", "listing")}
    known = store.log("scan_start", STARTS).filter(F.col("scan_id") == scan_id).collect()
    if known:
        return {r["state"]: r["version"] for r in known}
    now = {n: t.version() for n, t in tables.items()}
    store.put_scan("scan_start", scan_id, store.spark.createDataFrame(list(now.items()), "state string, version int"))
    return now


def scan_job(
    store: Store, inputs: ScanInputs, config: EngineConfig, now: Column, calls: int | None = None,
    resolutions: int | None = None, backfill: bool = False, force_fresh: bool = False, scan_id: str | None = None,
) -> ScanResult:
    """Scan with the stored caches and state, and store what it found: listings, cache
    rows, watch rows, reviews, the scan log, barcodes to look up, and alerts to be sent.
    Listings are compared with those stored by the scan before, unless `inputs` brings its
    own. The alert state stays as it is until `record_alerts` is told what was delivered. A
    job that is run again under the same `scan_id` starts from the state its first run
    started from, and replaces its own outbox and log rows."""
    scan_id = scan_id or uuid.uuid4().hex
    sent = store.log("alert_outbox", OUTBOX).filter(F.col("scan_id") != scan_id).select("key", "retailer", "url", "size_label").distinct()
    start = _started_from(store, scan_id)
    # what sold out since it was alerted is new again when it comes back
    sold_out = materialize(alerts.sold_out(sent, inputs.listing))
    alerted = alerts.mark_out_of_stock(store.alerts.read(start["alerts"]), sold_out)
    if not sold_out.isEmpty():
        mark_out_of_stock(store, sold_out)
    previous = inputs.previous
    if previous is None and start["listing"]:
        previous = store.listing.read(start["listing"])
    state_now = replace(
        inputs, resolution=store.resolution.read(start["resolution"]), watch=store.watch.read(start["watch"]), alert_state=alerted,
        gtin_map=store.gtin_map.read(start["gtin_map"]), previous=None if force_fresh else previous,
    )
    result = scan(state_now, config, now, calls, resolutions, backfill)
    # each part is computed once, then stored
    parts = ("resolution", "watch", "reviews", "out_of_stock", "stats", "barcodes")
    result = replace(result, **{part: materialize(getattr(result, part)) for part in parts})
    store.put_scan("alert_outbox", scan_id, result.alerts.select(
        "key", "retailer", "url", "size_label", "gate_profit", "in_stock", "reason", "text", now.alias("made_at")))
    store.put_scan("barcodes_due", scan_id, result.barcodes)
    log_scan(store, result.stats.withColumn("started_at", now), scan_id)
    put_resolution(store, result.resolution)
    put_watch(store, result.watch)
    add_reviews(store, result.reviews)
    if not result.out_of_stock.isEmpty():
        mark_out_of_stock(store, result.out_of_stock)
    # a page that was read tells more than the grid did
    put_listings(store, result.seen, now)
    return result


def live_report(alerts_table: DataFrame, listing: DataFrame, quotes: DataFrame, config: EngineConfig, limit: int):
    """(live opportunities, the rest with the reason)."""
    checked = report.verify(alerts_table, listing, quotes, config)
    return report.live(checked, limit), report.gone(checked)


def status(store: Store, listing: DataFrame, quotes: DataFrame) -> DataFrame:
    resolution = store.resolution.read()
    return monitor.status_summary(
        retail_products=listing, codes_resolved=resolution.filter("found"),
        codes_unmatched=resolution.filter("NOT found"), market_snapshots=quotes,
        alerts=store.alerts.read(), open_reviews=reviews(store).filter(~F.col("resolved")),
    )
