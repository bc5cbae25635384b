"""Monitoring figures over the state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions.times import age_seconds
from spreadlake.operators.ordered import RowsSince, RunningSum, with_ordered


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, 0 for an empty whole."""
    return F.when(whole != 0, F.round(F.lit(100.0) * part / whole, digits)).otherwise(F.lit(0.0))


def scan_stats(seen: DataFrame, candidates: DataFrame, opportunities: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counts per shop of one scan. Each input is counted before it is joined."""

    def per_shop(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("retailer").agg(F.count(F.lit(1)).alias(name))

    out = per_shop(seen, "products_seen")
    for df, name in ((candidates, "candidates"), (opportunities, "opportunities"), (alerts, "alerts_sent")):
        out = out.join(per_shop(df, name), "retailer", "left")
    names = ("products_seen", "candidates", "opportunities", "alerts_sent")
    return out.select("retailer", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def coverage(listing: DataFrame, resolution: DataFrame, approximate: bool = False) -> DataFrame:
    """Listings, stock, distinct codes, and how many codes were looked up."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    shop = listing.agg(
        F.count(F.lit(1)).alias("retail_products"),
        F.count_if("in_stock").alias("in_stock"),
        distinct(F.col("style_code")).alias("distinct_style_codes"),
    )
    looked = resolution.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("found").alias("matched"),
        F.count_if(~F.col("found")).alias("unmatched"),
    )
    # two one-row aggregates side by side
    both = shop.withColumn("_one", F.lit(1)).join(looked.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn(
        "pending", F.greatest(F.col("distinct_style_codes") - F.col("checked"), F.lit(0))
    ).withColumn("percent", percent(F.col("checked"), F.col("distinct_style_codes")))


def exact_median(values: DataFrame, value: str) -> DataFrame:
    """One row, `median`: the middle value, or the mean of the two middle ones.

    An exact percentile aggregate would hold every distinct value in one task.
    Values are counted instead, the counts are summed along the order, and only
    the values the middle positions fall on are looked at.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    placed = with_ordered(counted, [], [F.col("_v")], _upto=RunningSum(F.col("_n")))
    total = placed.agg(F.coalesce(F.max("_upto"), F.lit(0)).alias("_all")).withColumn("_one", F.lit(1))
    before = F.col("_upto") - F.col("_n")
    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1

    def at(place: Column) -> Column:
        return F.max(F.when((before < place) & (place <= F.col("_upto")), F.col("_v")))

    joined = placed.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return joined.agg(((at(lower) + at(upper)) / 2).alias("median"))


def market_health(quotes: DataFrame, now: Column, refresh_minutes: int) -> DataFrame:
    """Snapshot counts and the exact median of bid over ask."""
    bid, ask = F.col("highest_bid"), F.col("lowest_ask")
    cutoff = now - F.expr(f"INTERVAL {int(refresh_minutes)} MINUTES")
    out = quotes.agg(
        F.count(F.lit(1)).alias("variant_snapshots"),
        F.count_if(F.col("fetched_at") >= cutoff).alias("fresh"),
        F.count_if(bid != 0).alias("with_live_bid"),
    )
    ratios = quotes.filter((bid != 0) & (ask != 0)).select((bid / ask).alias("ratio"))
    median = exact_median(ratios, "ratio").withColumnRenamed("median", "median_bid_ask")
    both = out.withColumn("_one", F.lit(1)).join(median.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("with_live_bid_pct", percent(F.col("with_live_bid"), F.col("variant_snapshots")))


def gtin_hit_rate(gtin_map: DataFrame) -> DataFrame:
    return gtin_map.agg(
        F.count(F.lit(1)).alias("looked_up"), F.count_if("found").alias("matched")
    ).withColumn("hit_rate", percent(F.col("matched"), F.col("looked_up")))


def budget_use(requests: DataFrame, now: Column, budget: int) -> DataFrame:
    """Requests in the last 24 hours against the daily budget."""
    return requests.filter(F.col("ts") >= now - F.expr("INTERVAL 24 HOURS")).agg(
        F.count(F.lit(1)).alias("used_24h")
    ).select(
        "used_24h", F.lit(budget).alias("budget"), percent(F.col("used_24h"), F.lit(budget)).alias("percent")
    )


def pruned_requests(requests: DataFrame, now: Column) -> DataFrame:
    return requests.filter(F.col("ts") >= now - F.expr("INTERVAL 24 HOURS"))


def alert_totals(state: DataFrame, now: Column) -> DataFrame:
    cutoff = now - F.expr("INTERVAL 24 HOURS")
    return state.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("last_alerted") >= cutoff).alias("last_24h")
    )


def status_summary(**tables: DataFrame) -> DataFrame:
    """One (item, n) row per table, each counted on its own."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def latest_scan(scan_log: DataFrame, policy: DataFrame, now: Column, in_flight: DataFrame | None = None) -> DataFrame:
    """Newest scan per configured shop, its age, and whether it is overdue."""
    names = [c for c in scan_log.columns if c != "retailer"]
    newest = scan_log.groupBy("retailer").agg(
        F.max_by(F.struct(*names), F.struct("started_at")).alias("s")
    ).select("retailer", "s.*")
    out = policy.select("retailer", "enabled", "scan_interval_minutes").join(newest, "retailer", "left")
    if in_flight is None:
        out = out.withColumn("scanning", F.lit(False))
    else:
        out = out.join(in_flight.select("retailer", "scanning"), "retailer", "left").withColumn(
            "scanning", F.coalesce("scanning", F.lit(False))
        )
    age = age_seconds(F.col("started_at"), now)
    overdue = F.col("enabled") & ~F.col("scanning") & (age > F.col("scan_interval_minutes") * 120)
    return out.withColumn("age_seconds", age).withColumn("overdue", F.coalesce(overdue, F.lit(False)))


def shop_order(status: DataFrame) -> DataFrame:
    """Enabled shops first, then by name."""
    return status.orderBy(~F.col("enabled"), F.col("retailer"))


def in_flight(events: DataFrame) -> DataFrame:
    """Is a scan running: started, and not finished since? `event` is start or
    finish, `at` its time."""
    started = F.max(F.when(F.col("event") == "start", F.col("at")))
    finished = F.max(F.when(F.col("event") == "finish", F.col("at")))
    return events.groupBy("retailer").agg(started.alias("started_at"), finished.alias("finished_at")).withColumn(
        "scanning",
        F.coalesce(
            F.col("started_at").isNotNull()
            & (F.col("finished_at").isNull() | (F.col("started_at") > F.col("finished_at"))),
            F.lit(False),
        ),
    )


def failure_streaks(runs: DataFrame, order: list[Column]) -> DataFrame:
    """Failures in a row at every run of a shop; a success resets the count.
    Needs `retailer` and boolean `ok`."""
    return with_ordered(runs, ["retailer"], order, failures_in_row=RowsSince(F.col("ok")))


def current_failures(runs: DataFrame, at: str) -> DataFrame:
    """Failures since the last success, per shop, by aggregation alone."""
    last_ok = runs.filter("ok").groupBy("retailer").agg(F.max(at).alias("_ok"))
    return (
        runs.join(F.broadcast(last_ok), "retailer", "left")
        .groupBy("retailer")
        .agg(F.count_if(~F.col("ok") & (F.col("_ok").isNull() | (F.col(at) > F.col("_ok")))).alias("failures"))
    )


def stale_after(policy: DataFrame) -> DataFrame:
    """One row: seconds without a finished scan after which a scanner is down."""
    return policy.agg(F.min(F.when(F.col("enabled"), F.col("scan_interval_minutes"))).alias("fastest")).select(
        F.greatest(F.coalesce("fastest", F.lit(15)) * 120, F.lit(1800)).alias("stale_after_s")
    )


def heartbeat(finished: DataFrame, policy: DataFrame, now: Column) -> DataFrame:
    """Up while the last finished scan is younger than twice the fastest enabled
    interval, and at least half an hour."""
    limit = stale_after(policy).withColumn("_one", F.lit(1))
    beat = finished.agg(F.max("at").alias("last_beat")).withColumn("_one", F.lit(1))
    age = age_seconds(F.col("last_beat"), now)
    return beat.join(limit, "_one").select(
        "last_beat", "stale_after_s", age.alias("age_seconds"),
        F.coalesce(age < F.col("stale_after_s"), F.lit(False)).alias("up"),
    )


def top_alerts(state: DataFrame, n: int = 15) -> DataFrame:
    return state.orderBy(F.desc("last_profit"), F.asc("key")).limit(n)


def recent_scans(scan_log: DataFrame, n: int = 20) -> DataFrame:
    return scan_log.orderBy(F.desc("started_at"), F.asc("retailer")).limit(n)
