"""Listing to catalog product: style code, title code, fuzzy name, cache.

Every step works on distinct lookups, not on listings: however many listings
share a code, it is matched once and joined back. All matches are equality
joins against an index with one row per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions import style, text
from spreadlake.functions.binding import evaluated_once
from spreadlake.operators.skew import BROADCAST_ROWS, lookup_join
from spreadlake.session import materialize

PRODUCT = ("product_id", "style_id", "title", "brand", "url_key")
EXACT, SECONDARY, FUZZY = 1.0, 0.95, 0.5
LOOKUP = ["style_code", "brand", "name"]

# Titles up to this many distinct tokens are verified without a second join.
INLINE_TOKENS = 40

# Longs in the bit map of a token set, and holders of a token that share a join key.
MAP_WORDS = 2
SPLIT_HOLDERS = 2_000


def _product(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in PRODUCT])


def _first() -> Column:
    """First product in catalog order."""
    return F.min_by(_product(), F.struct("ordinal", "product_id"))


def style_index(catalog: DataFrame) -> DataFrame:
    """Normalised code -> first catalog product that accepts it."""
    return (
        catalog.select("*", F.explode(style.catalog_keys(F.col("style_id"), F.col("title"))).alias("code_key"))
        .groupBy("code_key").agg(_first().alias("style_hit"))
    )


def title_index(catalog: DataFrame) -> DataFrame:
    """(Title code, brand) -> first product without a style id of its own."""
    blank = F.trim(F.coalesce(F.col("style_id"), F.lit(""))) == ""
    return (
        catalog.filter(blank)
        .withColumn("brand_key", text.brand_key(F.col("brand")))
        .filter(F.col("brand_key").isNotNull())
        .select("*", F.explode(style.title_codes(F.col("title"))).alias("code_key"))
        .groupBy("code_key", "brand_key").agg(_first().alias("title_hit"))
    )


def lookups(listing: DataFrame) -> DataFrame:
    """Distinct (code, brand, name) with the candidate codes to try."""
    distinct = listing.filter(F.col("style_code") != "").select(*LOOKUP).distinct()
    # without the barrier the filter below would take the parsing of the codes
    # under the distinct, to every listing
    return (
        evaluated_once(distinct, "codes", style.lookup_codes(F.col("style_code")))
        .withColumn("cache_key", F.get("codes", F.lit(0)))
        .filter(F.col("cache_key").isNotNull())
    )


def match_codes(need: DataFrame, catalog: DataFrame) -> DataFrame:
    """Best exact match per lookup: the earliest candidate wins, and for one
    candidate its style id before a title token."""
    tried = (
        need.select(*LOOKUP, F.posexplode("codes").alias("rank", "code"))
        .withColumn("code_key", style.normalize_code(F.col("code")))
        .withColumn("brand_key", text.brand_key(F.col("brand")))
        .filter(F.col("code_key") != "")
    )
    hits = lookup_join(tried, style_index(catalog), ["code_key"])
    hits = lookup_join(hits, title_index(catalog), ["code_key", "brand_key"])
    found = hits.filter(F.col("style_hit").isNotNull() | F.col("title_hit").isNotNull()).withColumns(
        {
            "hit": F.coalesce("style_hit", "title_hit"),
            "method": F.when(F.col("style_hit").isNotNull(), "style").otherwise("title"),
        }
    )
    best = F.min_by(F.struct("hit", "method", "rank"), F.col("rank")).alias("best")
    return found.groupBy(*LOOKUP).agg(best).select(
        *LOOKUP,
        F.col("best.hit").alias("hit"),
        F.col("best.method").alias("method"),
        F.when(F.col("best.rank") == 0, F.lit(EXACT)).otherwise(F.lit(SECONDARY)).alias("confidence"),
    )


def token_map(tokens: Column) -> Column:
    """MAP_WORDS longs in which every token sets one bit."""
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(64 * MAP_WORDS)))

    def word(k: int) -> Column:
        own = F.filter(places, lambda p: F.floor(p / 64) == k)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda bits, p: bits.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(p, F.lit(64)).cast("int"))))

    return F.struct(*[word(k).alias(f"m{k}") for k in range(MAP_WORDS)])


def surely_missing(want: str, got: str) -> Column:
    """At least so many tokens of one map are not among those of another: each bit that is
    set in the first alone stands for one or more of them."""
    return reduce(
        lambda a, b: a + b,
        [F.bit_count(F.col(f"{want}.m{k}").bitwiseAND(F.bitwise_not(F.col(f"{got}.m{k}")))) for k in range(MAP_WORDS)])


def spread_postings(postings: DataFrame, probes: DataFrame, holders: DataFrame, split: int) -> tuple[DataFrame, DataFrame]:
    """Add `part` to both sides of a join by (fuzzy_brand, token): the postings of a token
    with many holders are dealt out over as many parts as it takes to have some `split` in
    each, and a probe is repeated for each part. There are at most postings / `split` such
    tokens."""
    hot = holders.filter(F.col("holders") > split).select(
        "fuzzy_brand", "token", F.ceil(F.col("holders") / split).cast("int").alias("_parts"))
    keys = ["fuzzy_brand", "token"]
    dealt = lookup_join(postings, hot, keys).withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("at"), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    repeated = lookup_join(probes, hot, keys).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    # a number of its own: the join makes far more rows than it reads, so partitions must not
    # be merged for being small
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, *keys, "part"), repeated


def _asked(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rows whose (fuzzy_brand, token) is among `tokens`, before they are shuffled, where
    those are few enough to be sent to all tasks; all rows otherwise, which the join sorts out."""
    some = materialize(tokens.select("fuzzy_brand", "token").distinct())
    return rows.join(F.broadcast(some), ["fuzzy_brand", "token"], "left_semi") if some.count() <= BROADCAST_ROWS else rows


def match_names(names: DataFrame, catalog: DataFrame, split: int = SPLIT_HOLDERS) -> DataFrame:
    """Fuzzy match of (brand, name): the catalog brand is the first word of the
    retail brand and the title covers at least 60 % of the name's tokens; the
    first such product in catalog order.

    A title that covers m of n tokens must hold one of any n - m + 1 of them, so
    only the rarest n - m + 1 tokens of a name are joined with the catalog. Bit maps
    of the token sets tell at once of most pairs that too many tokens differ; only the
    others are verified on the whole sets. Postings of tokens that no name asks for are not
    shuffled, and those of a token that many titles of a brand hold are dealt over several join keys. Equal names, and catalog products with equal
    brand and tokens, are handled once.
    """
    # both sides are used several times, and cutting text into words is the
    # dear part, so each is written once
    split_names = evaluated_once(
        names.withColumn("fuzzy_brand", text.brand_key(F.col("brand"))), "want",
        F.array_sort(text.tokens(F.col("name"))),
    )
    wanted = materialize(split_names.filter(F.col("fuzzy_brand").isNotNull() & (F.size("want") > 0)))
    # m / n >= 0.6 for whole numbers: m is 3n/5 rounded up
    sets = wanted.select("fuzzy_brand", "want").distinct().withColumns({
        "at_least": F.floor((F.size("want") * 3 + 4) / 5).cast("int"), "want_map": token_map(F.col("want"))})
    worded = evaluated_once(
        catalog.withColumn("fuzzy_brand", F.lower(F.coalesce(F.col("brand"), F.lit("")))), "got",
        F.array_sort(text.tokens(F.coalesce(F.col("title"), F.lit("")))),
    )
    have = materialize(
        worded.groupBy("fuzzy_brand", "got")
        .agg(F.min(F.struct("ordinal", "product_id")).alias("at"), _first().alias("hit"))
        .withColumn("got_map", token_map(F.col("got")))
    )
    n_got = F.size("got")
    # a short title travels with its postings and is verified on the spot; a long
    # text would be copied once per word, so it is fetched again for its candidates
    postings = have.select(
        "fuzzy_brand", "at", F.when(n_got <= INLINE_TOKENS, F.col("got")).alias("got"), n_got.alias("n_got"), "got_map",
        F.explode("got").alias("token"))
    wants = sets.select("fuzzy_brand", "want", "want_map", "at_least", F.explode("want").alias("token"))
    # counted once: they order the tokens of a name and deal out the postings
    holders = materialize(_asked(have.select("fuzzy_brand", F.explode("got").alias("token")), wants).groupBy("fuzzy_brand", "token").agg(
        F.count(F.lit(1)).alias("holders")))
    scored = lookup_join(wants, holders, ["fuzzy_brand", "token"])
    by = F.array_sort(F.collect_list(F.struct(F.coalesce("holders", F.lit(0)).alias("n"), "token"))).alias("by")
    rarest = (
        scored.groupBy("fuzzy_brand", "want", "want_map", "at_least").agg(by)
        .select(
            "fuzzy_brand", "want", "want_map", "at_least",
            F.explode(F.slice("by", F.lit(1), F.size("want") - F.col("at_least") + 1)).alias("p"),
        )
        .filter(F.col("p.n") > 0)
        .select("fuzzy_brand", "want", "want_map", "at_least", F.col("p.token").alias("token"))
    )
    rarest = materialize(rarest)
    dealt, probes = spread_postings(_asked(postings, rarest), rarest, holders, split)
    near = (F.col("n_got") >= F.col("at_least")) & (
        surely_missing("want_map", "got_map") <= F.size("want") - F.col("at_least"))
    covers = F.size(F.array_intersect("want", "got")) >= F.col("at_least")
    candidates = probes.join(dealt, ["fuzzy_brand", "token", "part"]).filter(near & (F.col("got").isNull() | covers))
    found = (
        candidates.groupBy("fuzzy_brand", "want", "at_least")
        .agg(F.min(F.when(F.col("got").isNotNull(), F.col("at"))).alias("at"))
    )
    if _any_long(have):
        long = (
            candidates.filter("got IS NULL").select("fuzzy_brand", "want", "at_least", "at").distinct()
            .join(have.filter(n_got > INLINE_TOKENS).select("fuzzy_brand", "at", "got"), ["fuzzy_brand", "at"])
            .filter(covers).groupBy("fuzzy_brand", "want", "at_least").agg(F.min("at").alias("at"))
        )
        found = found.unionByName(long).groupBy("fuzzy_brand", "want", "at_least").agg(F.min("at").alias("at"))
    best = found.filter(F.col("at").isNotNull()).join(have.select("fuzzy_brand", "at", "hit"), ["fuzzy_brand", "at"])
    return (
        wanted.join(best.select("fuzzy_brand", "want", "hit"), ["fuzzy_brand", "want"])
        .drop("fuzzy_brand", "want")
    )


def _any_long(have: DataFrame) -> bool:
    """Whether a catalog text is too long to be verified on the spot."""
    return not have.filter(F.size("got") > INLINE_TOKENS).select("at").isEmpty()


def resolve(listing: DataFrame, catalog: DataFrame, fuzzy: bool = True, need: DataFrame | None = None) -> DataFrame:
    """The full cascade: one row per lookup, `found` false when nothing fits."""
    # the distinct lookups and their exact answers each feed two branches
    need = materialize(lookups(listing) if need is None else need)
    keyed = materialize(_null_safe_left(need, match_codes(need, catalog), LOOKUP))
    if fuzzy:
        open_ = (
            keyed.filter(F.col("hit").isNull() & (F.col("brand") != "") & (F.col("name") != ""))
            .select("brand", "name").distinct()
        )
        names = match_names(open_, catalog).select("brand", "name", F.col("hit").alias("fuzzy_hit"))
        out = keyed.join(names, ["brand", "name"], "left")
    else:
        out = keyed.withColumn("fuzzy_hit", F.lit(None).cast(keyed.schema["hit"].dataType))
    is_fuzzy = F.col("hit").isNull() & F.col("fuzzy_hit").isNotNull()
    return out.select(
        *LOOKUP, "codes", "cache_key",
        F.coalesce("hit", "fuzzy_hit").alias("product"),
        F.when(is_fuzzy, "fuzzy").otherwise(F.col("method")).alias("method"),
        F.when(is_fuzzy, F.lit(FUZZY)).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.coalesce("hit", "fuzzy_hit").isNotNull().alias("found"),
    )


def _null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        same = term if same is None else same & term
    return left.join(renamed, same, "left").drop(*[f"_r_{k}" for k in keys])


def attach(listing: DataFrame, resolved: DataFrame) -> DataFrame:
    """Give every listing its catalog product; NULL where there is none."""
    slim = resolved.filter("found").select(*LOOKUP, "product", "method", "confidence")
    keyed = _with_set_keys(listing)
    return lookup_join(keyed, _with_set_keys(slim).drop("brand", "name"), ["style_code", *_SET_KEYS]).select(
        *listing.columns, "product", "method", "confidence"
    )


_SET_KEYS = ["_brand_key", "_name_key"]


def _with_set_keys(df: DataFrame) -> DataFrame:
    """Brand and name as join keys that are never NULL, as a missing one has to
    meet a missing one."""
    return df.withColumns(
        {k: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for k, c in zip(_SET_KEYS, ("brand", "name"))}
    )


# -- resolution cache ---------------------------------------------------------

def cache_rows(resolved: DataFrame, now: Column) -> DataFrame:
    """One cache row per first candidate; the surest answer is kept."""
    best = F.min_by(
        F.struct("product", "confidence", "found"),
        F.struct(-F.col("confidence"), F.col("product.product_id")),
    ).alias("b")
    return resolved.groupBy("cache_key").agg(best).select(
        "cache_key", F.col("b.found").alias("found"),
        *[F.col(f"b.product.{c}").alias(c) for c in PRODUCT],
        F.col("b.confidence").alias("confidence"), now.alias("resolved_at"),
    )


def cache_row_valid(retail_brand: Column, now: Column, negative_days: int) -> Column:
    """May a cached row still be used? Misses expire; sure hits must pass the
    current matching rules again; fuzzy hits can never alert and are kept."""
    age = F.unix_micros(now) - F.unix_micros(F.col("resolved_at"))
    miss_ok = age <= F.lit(negative_days * 86_400_000_000)
    blank = F.trim(F.coalesce(F.col("style_id"), F.lit(""))) == ""
    rules_ok = style.style_ids_match(F.col("cache_key"), F.col("style_id"), F.col("title")) | (
        blank
        & text.brands_agree(retail_brand, F.col("brand"))
        & style.code_in_title(F.col("cache_key"), F.col("title"))
    )
    return F.when(~F.col("found"), miss_ok).when(F.col("confidence") < SECONDARY, True).otherwise(rules_ok)


def check_cache(need: DataFrame, cache: DataFrame, now: Column, negative_days: int) -> DataFrame:
    """Each lookup with its usable cache row (`cached` true) or none."""
    asked = need.select(*[F.col(c).alias(f"_need_{c}") if c in PRODUCT else F.col(c) for c in need.columns])
    joined = lookup_join(asked, cache, ["cache_key"])
    valid = F.coalesce(
        F.col("resolved_at").isNotNull() & cache_row_valid(F.col("_need_brand"), now, negative_days), F.lit(False)
    )
    marked = joined.withColumn("cached", valid)
    return marked.select(
        *[F.col(f"_need_{c}").alias(c) if c in PRODUCT else F.col(c) for c in need.columns],
        "cached",
        F.when(F.col("cached"), F.col("found")).alias("found"),
        F.when(F.col("cached") & F.col("found"), _product()).alias("product"),
        F.when(F.col("cached"), F.col("confidence")).alias("confidence"),
        (F.col("resolved_at").isNotNull() & ~F.col("cached")).alias("dropped"),
    )


def due_for_resolution(need: DataFrame, cache: DataFrame, now: Column, negative_days: int) -> DataFrame:
    """Lookups no valid cache row answers."""
    checked = check_cache(need, cache, now, negative_days)
    return checked.filter(~F.col("cached")).select(*need.columns)


def split_by_confidence(listing: DataFrame, minimum: float) -> tuple[DataFrame, DataFrame]:
    """(sure enough to go on, for review); unmatched listings are in neither."""
    matched = listing.filter(F.col("product").isNotNull())
    sure = F.col("confidence") >= minimum
    return matched.filter(sure), matched.filter(~sure)
