"""Streams: run over the whole table in time order, then compared as a batch.

The input is written to a folder in three parts by time; after each part the
stream runs to the end of what is there, on one checkpoint, so that state has to
carry over between runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from spreadlake.checks import views as v
from spreadlake.checks.registry import query
from spreadlake.sources.landed import stream_table
from spreadlake.streaming import alerts, budget, cadence, changes, position_watch, timed
from spreadlake.session import empty_table
from spreadlake.streaming.batches import BatchOutput, StateLog, append_to_files, run_to_end, scratch

CUTS = ("2024-01-11", "2024-01-21")


# Every thirteenth event comes one part late.
LATE = "event_id % 13 = 0"
PART = f"""least(2, CASE WHEN ts < TIMESTAMP '{CUTS[0]}' THEN 0 WHEN ts < TIMESTAMP '{CUTS[1]}' THEN 1 ELSE 2 END
    + CASE WHEN {LATE} THEN 1 ELSE 0 END)"""


def _parts(rows: DataFrame, at: str, cuts: tuple[str, str]) -> list[DataFrame]:
    first, second = (F.lit(c).cast("timestamp") for c in cuts)
    t = F.col(at)
    late = F.col("late").cast("int") if "late" in rows.columns else F.lit(0)
    part = F.least(F.lit(2), (t >= first).cast("int") + (t >= second).cast("int") + late)
    return [rows.filter(part == i).drop("late") for i in range(3)]


def _run(rows: DataFrame, schema: str, at: str, make_step, cuts=CUTS) -> DataFrame:
    spark = rows.sparkSession
    out, checkpoint = scratch(spark, "stream")
    folder = f"{out}-input"
    output = BatchOutput(spark, out)
    step = make_step(f"{out}-state", output)
    for part in _parts(rows, at, cuts):
        part.write.mode("append").parquet(folder)
        run_to_end(stream_table(spark, folder, schema), step, checkpoint)
    return output.read()


@query("alerts_stream", f"""
    WITH e AS (SELECT 'k' || user_id AS key, ts, value, event_id % 4 <> 0 AS in_stock, {PART} AS part,
                 CASE WHEN event_type IN ('purchase', 'click') THEN 'offer' WHEN event_type = 'view' THEN 'delivered' ELSE 'gone' END AS kind
               FROM events WHERE event_type <> 'error'),
    s AS (SELECT *, last_value(CASE WHEN kind = 'delivered' THEN value END IGNORE NULLS) OVER w AS last_profit,
                 last_value(CASE WHEN kind = 'delivered' THEN in_stock WHEN kind = 'gone' THEN false END IGNORE NULLS) OVER w AS was,
                 count(*) FILTER (kind <> 'offer') OVER w AS news
          FROM e WINDOW w AS (PARTITION BY key ORDER BY part, ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    r AS (SELECT *, CASE WHEN last_profit IS NULL THEN 'new' WHEN NOT was AND in_stock THEN 'restock'
                         WHEN abs(value - last_profit) >= 10 THEN 'profit_change' ELSE 'duplicate' END AS reason FROM s)
    SELECT key, epoch_us(ts) AS at_us, value AS profit, reason FROM r WHERE kind = 'offer' AND reason <> 'duplicate'
    QUALIFY row_number() OVER (PARTITION BY key, part, news ORDER BY ts) = 1
""")
def alerts_stream(spark, sf):
    """Offers against delivery receipts, some of either late: only a receipt moves the
    state, and offers with no news between them are one alert a batch."""
    rows = v.events(spark, sf).filter("event_type <> 'error'").selectExpr(
        "concat('k', user_id) AS key", "ts AS at",
        "CASE WHEN event_type IN ('purchase', 'click') THEN 'offer' WHEN event_type = 'view' THEN 'delivered' ELSE 'gone' END AS kind",
        "value AS profit", "event_id % 4 <> 0 AS in_stock", "cast(event_id AS string) AS payload", f"{LATE} AS late",
    )

    def make(state_path, output):
        return alerts.step(StateLog(spark, state_path, alerts.STATE, ["key"], "at"), output, 10.0)

    out = _run(rows, alerts.INPUT, "at", make)
    return out.select("key", F.unix_micros("at").alias("at_us"), "profit", "reason")


@query("position_watch_stream", f"""
    WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('purchase', 'click', 'view') THEN value END AS bid FROM events
               WHERE user_id % 3 = 0 AND (user_id % 2 = 0 OR ts < TIMESTAMP '2024-01-25')),
    l AS (SELECT *, lag(bid) OVER w AS last_bid, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    e AS (SELECT *, CASE WHEN rn = 1 THEN 'baseline' WHEN bid IS NULL AND last_bid IS NOT NULL THEN 'bid_gone'
      WHEN bid IS NOT NULL AND last_bid IS NULL THEN 'bid_back' WHEN abs(bid - last_bid) >= 25 THEN 'bid_moved'
      WHEN {v.profit_sql('bid', '40.0::DOUBLE')} < 0 AND {v.profit_sql('last_bid', '40.0::DOUBLE')} >= 0 THEN 'underwater' ELSE 'none' END AS event FROM l)
    SELECT 'v' || user_id AS variant_id, epoch_us(ts) AS at_us, last_bid, bid, event FROM e WHERE event NOT IN ('baseline', 'none')
""")
def position_watch_stream(spark, sf):
    """Bid transitions of owned positions until their watch ends."""
    rows = v.events(spark, sf).selectExpr(
        "concat('v', user_id) AS variant_id", "ts AS at",
        "CASE WHEN event_type IN ('purchase', 'click', 'view') THEN value END AS bid",
    )
    positions = v.table(spark, sf, "events").filter("user_id % 3 = 0").select("user_id").distinct().selectExpr(
        "concat('v', user_id) AS variant_id", "40.0D AS paid", "25.0D AS move",
        "CASE WHEN user_id % 2 = 1 THEN timestamp'2024-01-25 00:00:00' END AS until",
    )

    def make(state_path, output):
        state = StateLog(spark, state_path, position_watch.STATE, ["variant_id"], "at")
        return position_watch.step(state, output, positions, v.config())

    out = _run(rows, position_watch.INPUT, "at", make)
    return out.select("variant_id", F.unix_micros("at").alias("at_us"), "last_bid", "bid", "event")


@query("listing_changes_stream", """
    WITH s AS (SELECT retailer, url, seen_at, min(price) AS price, bool_or(in_stock) AS in_stock,
                 least(2, CASE WHEN seen_at < TIMESTAMP '1997-01-01' THEN 0 WHEN seen_at < TIMESTAMP '1999-01-01' THEN 1 ELSE 2 END
                   + CASE WHEN dayofyear(seen_at) % 7 = 0 THEN 1 ELSE 0 END) AS part FROM listing GROUP BY ALL),
    l AS (SELECT *, row_number() OVER w AS rn, lag(price) OVER w AS old_price, lag(in_stock) OVER w AS old_stock FROM s WINDOW w AS (PARTITION BY retailer, url ORDER BY part, seen_at))
    SELECT retailer, url, epoch_us(seen_at) AS at_us, price, old_price, rn = 1 AS is_new, coalesce(price < old_price - 0.01::DOUBLE, false) AS price_dropped,
           coalesce(NOT old_stock AND in_stock, false) AS restocked
    FROM l WHERE rn = 1 OR price < old_price - 0.01::DOUBLE OR (NOT old_stock AND in_stock)
""", ("listing",))
def listing_changes_stream(spark, sf):
    """New, cheaper and restocked listings, one sighting per day, some a part late."""
    rows = v.listing(spark, sf).groupBy("retailer", "url", F.col("seen_at").alias("at")).agg(
        F.min("price").alias("price"), F.bool_or("in_stock").alias("in_stock")
    ).withColumn("late", F.dayofyear("at") % 7 == 0)

    def make(state_path, output):
        return changes.step(StateLog(spark, state_path, changes.STATE, changes.KEYS, "at"), output)

    out = _run(rows, changes.INPUT, "at", make, cuts=("1997-01-01", "1999-01-01"))
    return out.select(
        "retailer", "url", F.unix_micros("at").alias("at_us"), "price", "old_price", "is_new", "price_dropped", "restocked"
    )


def _event_stream(spark, sf) -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def _to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    out, checkpoint = scratch(spark, "table")
    query_ = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("budget_stream", """
    WITH c AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS cell, count(*) AS n FROM events GROUP BY 1),
    s AS (SELECT cell + to_minutes(15 * (1 + k)) AS span_end, n FROM c, range(96) t(k))
    SELECT epoch_us(span_end) AS end_us, sum(n)::BIGINT AS used FROM s GROUP BY span_end
    HAVING span_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def budget_stream(spark, sf):
    """Requests per sliding day, as far as the watermark has closed the spans."""
    spans = _to_table(budget.rolling_requests(_event_stream(spark, sf)))
    return spans.select(F.unix_micros("span_end").alias("end_us"), "used")


@query("quote_history_stream", """
    SELECT strftime(ts, '%Y-%m-%d') AS quote_date, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1
""")
def quote_history_stream(spark, sf):
    """Quotes filed under their date as they arrive."""
    quotes = _event_stream(spark, sf).filter("event_type <> 'error'").selectExpr(
        "concat('v', user_id) AS variant_id", "value AS highest_bid", "ts AS fetched_at"
    )
    out, checkpoint = scratch(spark, "quotes")
    append_to_files(budget.dated_quotes(quotes), out, checkpoint, ["quote_date"]).awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("quote_date").cast("string").alias("quote_date")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("negative_expiry_stream", """
    WITH RECURSIVE e AS (SELECT 'k' || user_id AS cache_key, ts FROM events),
    t AS (
      SELECT cache_key, min(ts) AS ts FROM e GROUP BY cache_key
      UNION ALL
      SELECT e.cache_key, min(e.ts) FROM t JOIN e ON e.cache_key = t.cache_key AND e.ts > t.ts + INTERVAL 4 DAYS GROUP BY e.cache_key)
    SELECT cache_key, epoch_us(ts) AS at_us FROM t
""")
def negative_expiry_stream(spark, sf):
    """Each code is tried, left alone for four days, and tried again after them."""
    rows = v.events(spark, sf).selectExpr("concat('k', user_id) AS cache_key", "ts AS at")

    def make(state_path, output):
        return budget.retry_step(StateLog(spark, state_path, budget.RETRY_STATE, ["cache_key"], "at"), output, 4)

    return _run(rows, budget.RETRY_STATE, "at", make).select("cache_key", F.unix_micros("at").alias("at_us"))


@query("heartbeat_stream", f"""
    WITH b AS (SELECT 'shop' || (user_id % 11) AS retailer, max(ts) AS beat FROM events GROUP BY 1)
    SELECT retailer, epoch_us(beat) AS beat_us,
      epoch({v.NOW_SQL}) - epoch(beat) < (SELECT greatest(coalesce(min(CASE WHEN enabled THEN scan_interval_minutes END), 15) * 120, 1800) FROM policy) AS up
    FROM b
""", ("policy",))
def heartbeat_stream(spark, sf):
    """Last finished scan per shop, kept up to date, and whether the shop is up."""
    finished = _event_stream(spark, sf).selectExpr("concat('shop', user_id % 11) AS retailer", "ts AS at")
    out, checkpoint = scratch(spark, "beats")
    output = BatchOutput(spark, out)

    def keep(batch, batch_id):
        output.put(0, budget.liveness(batch, v.config().policy_frame(spark), v.now()))

    stream = budget.last_beats(finished)
    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
    return output.read().select("retailer", F.unix_micros("last_beat").alias("beat_us"), "up")


@query("refresh_due_stream", """
    WITH now_ AS (SELECT max(ts) AS t FROM events WHERE event_type <> 'error'),
    q AS (SELECT 'v' || user_id AS variant_id, max(ts) AS fetched_at FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT x.product_id, count(*) AS n_variants, count(*) FILTER (coalesce(fetched_at >= t - INTERVAL 45 MINUTES, false)) AS n_fresh
    FROM variant x LEFT JOIN q USING (variant_id), now_ GROUP BY 1 HAVING n_fresh < n_variants
""", ("variant",))
def refresh_due_stream(spark, sf):
    """Products due after the last quote, all of them on the shortest cadence."""
    rows = v.events(spark, sf).filter("event_type <> 'error'").selectExpr(
        "concat('v', user_id) AS variant_id", "ts AS fetched_at"
    )
    watch = empty_table(spark, "product_id string, best_profit double")

    def make(state_path, output):
        state = StateLog(spark, state_path, cadence.STATE, ["variant_id"], "fetched_at")
        return cadence.step(state, output, v.variants(spark, sf), watch, v.config())

    out = _run(rows, cadence.INPUT, "fetched_at", make)
    last = out.agg(F.max("as_of").alias("as_of"))
    return out.join(F.broadcast(last), "as_of", "left_semi").select("product_id", "n_variants", "n_fresh")


def _run_timed(rows: DataFrame, schema: str, make_stream) -> DataFrame:
    """The parts of the input one after the other on one checkpoint, by file sink."""
    spark = rows.sparkSession
    out, checkpoint = scratch(spark, "timed")
    folder = f"{out}-input"
    for part in _parts(rows, "at", CUTS):
        part.write.mode("append").parquet(folder)
        stream = make_stream(stream_table(spark, folder, schema))
        timed.start(stream, out, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("miss_expiry_timers", """
    WITH e AS (SELECT 'k' || user_id AS cache_key, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next_ts,
                 (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS closed FROM events)
    SELECT cache_key, epoch_us(ts) AS tried_us, epoch_us(ts + INTERVAL 2 DAYS) AS due_us FROM e
    WHERE CASE WHEN next_ts IS NULL THEN ts + INTERVAL 2 DAYS <= closed ELSE next_ts > ts + INTERVAL 2 DAYS END
""")
def miss_expiry_timers(spark, sf):
    """Codes fall due two days after they were last tried, also those not seen again."""
    rows = v.events(spark, sf).selectExpr("concat('k', user_id) AS cache_key", "ts AS at")
    out = _run_timed(rows, timed.MISSES, lambda stream: timed.expired_misses(stream, 2))
    return out.select("cache_key", F.unix_micros("tried_at").alias("tried_us"), F.unix_micros("due_at").alias("due_us"))


# Limits in minutes under which products of the test tables come and go.
_TIERS = {"refresh_minutes_hot": 2 * 1440, "refresh_minutes_warm": 4 * 1440, "refresh_minutes_cold": 8 * 1440}


@query("cadence_timers", f"""
    WITH v AS (SELECT DISTINCT user_id % 50 AS p, user_id AS x FROM events),
    w AS (SELECT DISTINCT p, CASE p % 4 WHEN 0 THEN {_TIERS['refresh_minutes_hot']} WHEN 1 THEN {_TIERS['refresh_minutes_cold']}
            WHEN 2 THEN {_TIERS['refresh_minutes_warm']} ELSE {_TIERS['refresh_minutes_hot']} END AS ttl FROM v),
    q AS (SELECT user_id % 50 AS p, user_id AS x, ts FROM events WHERE event_type <> 'error'),
    t AS (SELECT p, ts, lead(ts) OVER (PARTITION BY p ORDER BY ts) AS next_ts FROM q),
    a AS (SELECT t.p, t.ts, any_value(t.next_ts) AS next_ts, v.x, max(q.ts) AS seen
          FROM t JOIN v ON t.p = v.p LEFT JOIN q ON q.p = v.p AND q.x = v.x AND q.ts <= t.ts GROUP BY t.p, t.ts, v.x),
    m AS (SELECT p, ts, any_value(next_ts) AS next_ts, CASE WHEN count(seen) = count(*) THEN min(seen) END AS oldest FROM a GROUP BY p, ts),
    d AS (SELECT m.p, m.ts, next_ts, oldest + to_minutes(ttl) AS due, ttl FROM m JOIN w USING (p)),
    told AS (
      SELECT p, due, ttl FROM d WHERE due >= ts AND CASE WHEN next_ts IS NULL THEN due <= (SELECT max(ts) FROM events WHERE event_type <> 'error') - INTERVAL 1 HOUR ELSE next_ts > due END
      UNION ALL
      SELECT p, TIMESTAMP '2023-12-31 00:00:00', {_TIERS['refresh_minutes_hot']} FROM w)
    SELECT 'p' || p AS product_id, epoch_us(due) AS due_us, CAST(ttl AS INTEGER) AS ttl_minutes FROM told
""")
def cadence_timers(spark, sf):
    """When each product falls due: first of all, as no variant has a quote, then whenever its
    oldest quote passes the limit of its tier. Products are profitable, without a bid, near
    the floor, or without a watch row."""
    config = v.config()
    config = replace(config, venue=replace(config.venue, **_TIERS))
    named = v.events(spark, sf).selectExpr(
        "concat('p', user_id % 50) AS product_id", "ts AS at", f"{cadence.QUOTE} AS kind", "concat('v', user_id) AS variant_id",
        "cast(NULL AS double) AS best_profit", "user_id % 50 AS p", "event_type")
    start = "timestamp'2023-12-31 00:00:00' AS at"
    variants = named.selectExpr("product_id", start, f"{cadence.VARIANT} AS kind", "variant_id", "best_profit").distinct()
    watch = named.filter("p % 4 < 3").selectExpr(
        "product_id", start, f"{cadence.WATCH} AS kind", "cast(NULL AS string) AS variant_id",
        f"CASE p % 4 WHEN 0 THEN {config.filters.min_profit + 1}D WHEN 2 THEN {config.filters.min_profit - config.venue.near_miss / 2}D END AS best_profit").distinct()
    quotes = named.filter("event_type <> 'error'").drop("p", "event_type")
    rows = variants.unionByName(watch).unionByName(quotes)
    out = _run_timed(rows, cadence.LINES, lambda stream: timed.due_products(stream, config))
    return out.select("product_id", F.unix_micros("due_at").alias("due_us"), "ttl_minutes")


# Every fourth report is not delivered.
_SENT = "event_id % 4 <> 0"


@query("position_receipts_stream", f"""
    WITH RECURSIVE c AS (
      SELECT user_id, ts, CASE WHEN event_type IN ('purchase', 'click', 'view') THEN value END AS bid, {_SENT} AS sent, {PART} AS part
      FROM events WHERE user_id % 3 = 0 AND (user_id % 2 = 0 OR ts < TIMESTAMP '2024-01-15')),
    n AS (SELECT *, {v.profit_sql('bid', '40.0::DOUBLE')} AS profit, row_number() OVER (PARTITION BY user_id ORDER BY part, ts) AS rn FROM c),
    s AS (
      SELECT user_id, rn, ts, bid, CAST(NULL AS DOUBLE) AS last_bid, 'baseline' AS event, bid AS kept, profit AS kept_profit FROM n WHERE rn = 1
      UNION ALL
      SELECT user_id, rn, ts, bid, last_bid, event,
        CASE WHEN event = 'none' OR sent THEN bid ELSE kept END, CASE WHEN event = 'none' OR sent THEN profit ELSE kept_profit END
      FROM (SELECT n.*, s.kept, s.kept_profit, s.kept AS last_bid,
              CASE WHEN n.bid IS NULL AND s.kept IS NOT NULL THEN 'bid_gone' WHEN n.bid IS NOT NULL AND s.kept IS NULL THEN 'bid_back'
                WHEN abs(n.bid - s.kept) >= 25 THEN 'bid_moved'
                WHEN n.bid IS NOT NULL AND coalesce(n.profit, -1) < 0 AND s.kept_profit >= 0 THEN 'underwater' ELSE 'none' END AS event
            FROM s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1)),
    ended AS (SELECT user_id, kept FROM s WHERE user_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)
    SELECT 'v' || user_id AS variant_id, epoch_us(ts) AS at_us, last_bid, bid, event FROM s WHERE event NOT IN ('baseline', 'none')
    UNION ALL
    SELECT 'v' || user_id, epoch_us(TIMESTAMP '2024-01-15'), kept, NULL, 'watch_ended' FROM ended
""")
def position_receipts_stream(spark, sf):
    """Bid transitions whose state waits for receipts, some of which never come; checks that
    arrive a part late; and the ends of watches, told by a timer."""
    checks = v.events(spark, sf).selectExpr(
        "concat('v', user_id) AS variant_id", "ts AS at", f"{position_watch.CHECK} AS kind",
        "CASE WHEN event_type IN ('purchase', 'click', 'view') THEN value END AS bid", f"{LATE} AS late", f"{_SENT} AS sent")
    receipts = checks.filter("sent").withColumns({"kind": F.lit(position_watch.RECEIPT), "bid": F.lit(None).cast("double")})
    rows = checks.unionByName(receipts).drop("sent")
    positions = v.table(spark, sf, "events").filter("user_id % 3 = 0").select("user_id").distinct().selectExpr(
        "concat('v', user_id) AS variant_id", "40.0D AS paid", "25.0D AS move",
        "CASE WHEN user_id % 2 = 1 THEN timestamp'2024-01-15 00:00:00' END AS until")
    out = _run_timed(rows, position_watch.LINES, lambda stream: timed.watched_positions(stream, positions, v.config(), "11 days"))
    return out.select("variant_id", F.unix_micros("at").alias("at_us"), "last_bid", "bid", "event")
