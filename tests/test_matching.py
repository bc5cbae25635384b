"""Resolution, sizes, barcodes, quotes against brute force on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from spreadlake import config as cfg, schemas
from spreadlake.functions import size as sz, style, text
from spreadlake.operators import barcodes, quotes, resolve, sizes
from tests import fixtures


def _catalog(spark, rows):
    return spark.createDataFrame(
        [(p, s, t, b, None, None, None, None, i) for i, (p, s, t, b) in enumerate(rows)], schemas.CATALOG_PRODUCT
    )


def _listing(spark, rows):
    return spark.createDataFrame(rows, "style_code string, brand string, name string")


def _resolved(spark, listing, catalog):
    out = resolve.resolve(_listing(spark, listing), _catalog(spark, catalog)).collect()
    return {r.style_code: (r.product and r.product.product_id, r.method, r.confidence) for r in out}


def test_cascade_order(spark):
    catalog = [
        ("later", "AB123-100", "Shoe again one", "Nike"), ("brandless", "", "Thing 75192 box", "Pokemon"),
        ("set", "X1111-100/Y2222-200", "Hoodie & Joggers Set", "Nike"), ("dual", "D1111/D2222", "One shoe", "Nike"),
        ("falcon", " ", "LEGO Falcon 75192", "LEGO"), ("plain", "VN000EBNBPN1", "Vans old", "Vans"),
    ]
    got = _resolved(spark, [
        ("AB123_100_8.5", "Nike", "n"), ("75192", "LEGO Star Wars", "n"), ("X1111-100", "Nike", "zzz yyy"), ("D2222", "Nike", "n"),
        ("VN000EBNBPN1_050", "Vans", "n"), ("QQ99999", "Nike", "One Shoe Again"), ("75193", None, "n"), ("75192x", None, "n"),
    ], catalog)
    assert got["AB123_100_8.5"] == ("later", "style", 0.95)
    assert got["75192"] == ("falcon", "title", 1.0)
    assert got["X1111-100"] == (None, None, 0.0)
    assert got["D2222"] == ("dual", "style", 1.0)
    assert got["VN000EBNBPN1_050"] == ("plain", "style", 0.95)
    assert got["QQ99999"] == ("later", "fuzzy", 0.5)
    assert got["75193"] == (None, None, 0.0)


def test_attach_meets_missing_brand_and_name(spark):
    catalog = _catalog(spark, [("p", "AB123-100", "Shoe", "Nike")])
    listing = _listing(spark, [("AB123-100", None, None), ("AB123-100", "Nike", ""), (None, "Nike", "x"), ("ZZ", None, None)])
    out = resolve.attach(listing, resolve.resolve(listing, catalog)).collect()
    assert len(out) == 4
    assert sorted((str(r.brand), str(r.name)) for r in out if r.product) == [("Nike", ""), ("None", "None")]


def _tokens(value):
    import re
    return {t for t in re.findall(r"[a-z0-9]+", value.lower()) if len(t) > 1 and t not in text.STOP_TOKENS}


@pytest.mark.parametrize("inline", [0, 2, 40])
def test_fuzzy_equals_brute_force(spark, inline, monkeypatch):
    monkeypatch.setattr(resolve, "INLINE_TOKENS", inline)
    rnd = random.Random(inline)
    words = ["air", "max", "low", "high", "red", "blue", "dunk", "the", "retro", "x", "90", "og", "se", "premium"]
    titles = [" ".join(rnd.choices(words, k=rnd.randint(0, 7))) for _ in range(60)] + ["air max"] * 20
    names = {" ".join(rnd.choices(words, k=rnd.randint(1, 6))) for _ in range(60)}
    brands = ["Nike", "nike", "Adidas"]
    catalog = [(f"p{i}", None, t, brands[i % 3]) for i, t in enumerate(titles)]
    asked = [(b, n) for n in names for b in ("Nike Sportswear", "ADIDAS")]
    got = resolve.match_names(spark.createDataFrame(asked, "brand string, name string"), _catalog(spark, catalog), split=3 + inline)
    want = {}
    for b, n in asked:
        w = _tokens(n)
        hit = next((p for p, _, t, c in catalog if w and c.lower() == b.lower().split()[0] and len(w & _tokens(t)) / len(w) >= 0.6), None)
        if hit:
            want[(b, n)] = hit
    assert {(r.brand, r.name): r.hit.product_id for r in got.collect()} == want


@pytest.mark.parametrize("sent", [resolve.BROADCAST_ROWS, 0])
def test_postings_no_name_asks_for_are_not_shuffled(spark, monkeypatch, sent):
    catalog = [(f"p{i}", "", " ".join(f"w{(7 * i + k) % 400}" for k in range(12)), "Nike" if i % 2 else "Vans") for i in range(200)]
    asked = [("Nike", "w3 w4 w5 w6 w7"), ("Vans", "w20 w21 nowhere"), ("Nike", "w1 w200 w399")]
    dealt, plain = [], resolve.spread_postings

    def kept(postings, probes, holders, split):
        dealt.append(({(r["fuzzy_brand"], r["token"]) for r in postings.collect()}, {(r["fuzzy_brand"], r["token"]) for r in probes.collect()}))
        return plain(postings, probes, holders, split)

    monkeypatch.setattr(resolve, "spread_postings", kept)
    monkeypatch.setattr(resolve, "BROADCAST_ROWS", sent)
    got = resolve.match_names(spark.createDataFrame(asked, "brand string, name string"), _catalog(spark, catalog))
    want = {}
    for brand, name in asked:
        words = set(name.split())
        for p, _, title, b in catalog:
            if b == brand and len(words & set(title.split())) / len(words) >= 0.6:
                want.setdefault((brand, name), p)
    assert want and {(r["brand"], r["name"]): r["hit"]["product_id"] for r in got.collect()} == want
    postings, probes = dealt[0]
    assert postings <= probes if sent else len(postings) > 300


def test_a_token_that_most_titles_hold_is_dealt_over_all_tasks(spark):
    postings = spark.range(6000).selectExpr(
        "'b' AS fuzzy_brand", "CASE WHEN id % 10 < 9 THEN 'common' ELSE concat('t', id) END AS token", "struct(id AS ordinal, 'p' AS product_id) AS at")
    holders = postings.groupBy("fuzzy_brand", "token").agg(F.count(F.lit(1)).alias("holders"))
    probes = spark.createDataFrame([("b", "common"), ("b", "t9")], "fuzzy_brand string, token string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        dealt, repeated = resolve.spread_postings(postings, probes, holders, 100)
        per_task = [r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        joined = repeated.join(dealt, ["fuzzy_brand", "token", "part"])
        assert len(per_task) == 8 and max(per_task) < 2 * 6000 / 8
        assert {r["part"]: r["count"] for r in dealt.filter("token = 'common'").groupBy("part").count().collect()}.keys() == set(range(54))
        assert joined.groupBy("token").count().orderBy("token").collect() == [("common", 5400), ("t9", 1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_maps_never_say_that_a_shared_token_is_missing(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(rnd.sample(words, rnd.randint(0, 12)), rnd.sample(words, rnd.randint(0, 200))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select(
        "a", "b", resolve.token_map(F.col("a")).alias("am"), resolve.token_map(F.col("b")).alias("bm"))
    got = df.select("a", "b", resolve.surely_missing("am", "bm").alias("n")).collect()
    assert all(r.n <= len(set(r.a) - set(r.b)) for r in got) and any(r.n > 3 for r in got)


def test_cap_reduces_a_cache_to_one_row_per_key(spark):
    resolved = resolve.resolve(
        _listing(spark, [("75192", "LEGO", "a"), ("75192", "Pokemon", "b")]), _catalog(spark, [("falcon", "", "LEGO 75192", "LEGO")])
    )
    rows = resolve.cache_rows(resolved, F.lit(fixtures.NOW)).collect()
    assert [(r.cache_key, r.found, r.product_id, r.confidence) for r in rows] == [("75192", True, "falcon", 1.0)]


# -- sizes ------------------------------------------------------------------------------

LABELS = [None, "", "42", "42,5", "EU 42", "42 2/3", "9", "9.5", "M", "Medium", "2XL", "FOO", "8"]


def test_size_match_equals_pairwise(spark):
    rnd = random.Random(11)
    variants = [
        (f"p{i % 6}", f"v{i:03d}", rnd.choice(LABELS), "US", {k: v for k, v in {"eu": rnd.choice(LABELS)}.items() if v is not None})
        for i in range(40)
    ]
    retail = [(f"p{rnd.randint(0, 6)}", rnd.choice(["EU", "us", "UK", "LETTER", None]), rnd.choice(LABELS[1:]), rnd.choice(LABELS), i) for i in range(150)]
    v = spark.createDataFrame(variants, schemas.CATALOG_VARIANT)
    r = spark.createDataFrame(retail, "product_id string, size_system string, size_label string, us_size string, id int")
    got = {x.id: (x.variant_id, x.size_confidence) for x in sizes.attach_variant(r, v).collect()}
    pairs = r.join(v.drop("size_system"), "product_id", "left").select(
        "id", "variant_id",
        sz.size_confidence(
            sz.retail_us_label(F.col("size_system"), F.col("size_label"), F.col("us_size")),
            sz.retail_eu_label(F.col("size_system"), F.col("size_label")), F.col("size"), sz.eu_conversion(F.col("conversions")),
        ).alias("c"),
    ).collect()
    want = {}
    for i in range(150):
        mine = sorted((p.variant_id, p.c) for p in pairs if p.id == i and p.variant_id and p.c > 0)
        full = [m for m in mine if m[1] >= 1]
        if len(full) > 1:
            want[i] = (full[0][0], 0.5)
        elif mine:
            want[i] = max(mine, key=lambda m: m[1]) if not full else full[0]
        else:
            want[i] = (None, 0.0)
    assert got == want


def test_sizeless(spark):
    rows = [("a", "1", None), ("b", "1", "  "), ("c", "1", "10"), ("d", "1", None), ("d", "2", None)]
    v = spark.createDataFrame(rows, "product_id string, variant_id string, size string")
    assert {r.product_id for r in sizes.sizeless_products(v).collect()} == {"a", "b"}


def test_unknown_stock_stays(spark):
    rows = [("u", [("42", "EU", None, None, True), ("43", "EU", None, None, None), ("44", "EU", None, None, False)])]
    df = spark.createDataFrame(rows, f"url string, sizes array<{schemas.SIZE}>")
    assert [r.size_label for r in sizes.explode_sizes(df).collect()] == ["42", "43"]


def test_barcode_verdicts(spark):
    m = spark.createDataFrame([("4006381333931", True, "p1", "v1", None), ("4006381333932", False, None, None, None)], schemas.GTIN_MAP)
    rows = spark.createDataFrame([("400-6381333931", "p1"), ("4006381333931", "p2"), ("4006381333932", "p1"), ("123", "p1"), (None, "p1")], "ean string, p string")
    got = barcodes.attach_gtin(rows, "ean", m).select("ean", "p", barcodes.verdict(F.col("p")).alias("v"), "gtin_known").collect()
    assert sorted((str(r.ean), r.p, r.v, r.gtin_known) for r in got) == sorted([
        ("400-6381333931", "p1", "same", True), ("4006381333931", "p2", "other", True), ("4006381333932", "p1", "unknown", True),
        ("123", "p1", "unknown", False), ("None", "p1", "unknown", False),
    ])


# -- quotes -----------------------------------------------------------------------------

def test_ttl_tiers(spark):
    c = cfg.EngineConfig()
    floor, near = c.filters.min_profit, c.venue.near_miss
    watch = spark.createDataFrame(
        [("nobid", None), ("hot", floor + 1), ("warm", floor - near / 2), ("cold", floor - near - 50)], "product_id string, best_profit double"
    )
    asked = spark.createDataFrame([("new",), ("nobid",), ("hot",), ("warm",), ("cold",)], "product_id string")
    got = {r.product_id: r.ttl_minutes for r in quotes.with_ttl(asked, watch, c).collect()}
    v = c.venue
    assert got == {"new": v.refresh_minutes_hot, "nobid": v.refresh_minutes_cold, "hot": v.refresh_minutes_hot,
                   "warm": v.refresh_minutes_warm, "cold": v.refresh_minutes_cold}


def test_budget_spares_listings_that_need_no_call(spark):
    rows = spark.createDataFrame([("s", i, i % 2 == 0) for i in range(20)], "retailer string, n int, needs boolean")
    kept = quotes.within_budget(rows, F.col("needs"), [F.asc("n")], 3).collect()
    assert sorted(r.n for r in kept) == sorted([n for n in range(20) if n % 2] + [0, 2, 4])


def test_best_upside_matches_every_variant(spark):
    rnd = random.Random(2)
    q = spark.createDataFrame(
        [(f"p{i % 4}", rnd.choice([None, 0.0, 40.0, 60.0, 200.0]), rnd.choice([None, 0.0, 90.0, 300.0])) for i in range(30)],
        "product_id string, highest_bid double, lowest_ask double",
    )
    from dataclasses import replace

    for live in (True, False):
        c = cfg.EngineConfig()
        c = replace(c, filters=replace(c.filters, require_live_bid=live))
        listing = spark.createDataFrame([(f"p{i}", 10.0 * i + 5) for i in range(5)], "product_id string, landed_cost double")
        got = {r.product_id: r.best_upside for r in quotes.assess(listing, q, c).collect()}
        each = quotes.variant_gate(listing.join(q, "product_id", "left"), F.col("landed_cost"), c)
        want = {r.product_id: r.g for r in each.groupBy("product_id").agg(F.max("gate_profit").alias("g")).collect()}
        assert got == want


def test_fees_of_all_of_the_price_are_refused(spark):
    c = cfg.EngineConfig(fees=cfg.FeeConfig(transaction_fee_pct=0.99, processing_fee_pct=0.02))
    with pytest.raises(ValueError):
        quotes.assess(spark.range(0), spark.range(0), c)
