"""Column functions, one row in and one value out."""

import random

import pytest
from pyspark.sql import functions as F

from spreadlake import config as cfg
from spreadlake.functions import barcode, money, size, style, text, times


def test_sku_candidates(evaluate):
    skus = {
        "HQ2010_005_8.5_CNF": ["HQ2010-005", "HQ2010-005-8.5", "HQ2010"],
        "IJ6884_30_32": ["IJ6884", "IJ6884-30", "IJ6884-30-32"],
        "HZ0728_L": ["HZ0728", "HZ0728-L"],
        "VN000EBNBPN1_050": ["VN000EBNBPN1-050", "VN000EBNBPN1"],
        "DD1391-100": ["DD1391-100"],
        "_CNF": [], "": [], "   ": [],
    }
    got = evaluate(lambda d: style.sku_candidates(d.s), "s string", [(k,) for k in skus])
    assert got == list(skus.values())


def test_lookup_codes_put_the_own_code_first(evaluate):
    got = evaluate(lambda d: style.lookup_codes(d.s), "s string", [("75192",), ("AB_8",), (None,), ("",)])
    assert got == [["75192"], ["AB_8", "AB", "AB-8"], [], []]


STYLE_CASES = [
    ("DD1391-100", "DD1391-100/DD1391 100", None, True),
    ("FB7921-473", "FB7921-473/FB8002-473", "Nike Club Hoodie & Joggers Set Navy", False),
    ("FB7921-473/FB8002-473", "FB7921-473/FB8002-473", "Nike Club Hoodie & Joggers Set Navy", True),
    ("CW2288-111", "315122-111/CW2288-111", "Nike Air Force 1 Low '07 White", True),
    ("FB7921-473", "FB7921-473/FB8002-473", None, False),
    ("A1234", "A1234,B5678", "", True),
    ("hq2010 005", "HQ2010-005", None, True),
    ("HQ2010-006", "HQ2010-005", "x", False),
    ("", "HQ2010-005", "x", False), ("HQ2010-005", None, "x", False), ("A", "", "x", False), ("A", "/", "x", False),
]


def test_style_ids(evaluate):
    got = evaluate(lambda d: style.style_ids_match(d.c, d.s, d.t), "c string, s string, t string", [c[:3] for c in STYLE_CASES])
    assert got == [c[3] for c in STYLE_CASES]


@pytest.mark.parametrize("title,multi", [
    ("Hoodie & Joggers Set", True), ("Tee 2-Piece", True), ("3 piece kit", True), ("two piece", True),
    ("Sunset Low", False), ("Masterpiece", False), (None, False), ("SETS", True),
])
def test_multi_item_titles(evaluate, title, multi):
    assert evaluate(lambda d: style.is_multi_item(d.t), "t string", [(title,)]) == [multi]


def test_code_in_title(evaluate):
    falcon = "LEGO Star Wars Millennium Falcon Ultimate Collector Series Set 75192"
    cases = [
        ("75192", falcon, True), ("GA-110PKM-7A", "Casio G-Shock x Pokemon GA-110PKM-7A", True),
        ("GA110PKM7A", "Casio G-Shock GA-110PKM-7A", True), ("75193", falcon, False),
        ("5192", "Gucci Jumbo GG Jogging Pant 715192", False), ("21044", "LEGO Architecture Set 210440", False),
        ("192", falcon, False), ("75192", None, False),
    ]
    got = evaluate(lambda d: style.code_in_title(d.c, d.t), "c string, t string", [c[:2] for c in cases])
    assert got == [c[2] for c in cases]


def test_regions(evaluate):
    titles = [
        ("Sony PS5 Pro Bundle (US Plug)", "US Plug"), ("Switch 2 (EU Plug)", "EU Plug"),
        ("Airwrap (220-240V US Plug)", "220-240V US Plug"), ("AirPods Max (2024)", None), (None, None),
    ]
    assert evaluate(lambda d: style.region_marker(d.t), "t string", [(t,) for t, _ in titles]) == [m for _, m in titles]
    pairs = [
        ("PS5 (US Plug)", "Sony PS5 Pro", "US Plug"), ("PS5 (US Plug)", "Sony PS5 Pro (US Plug)", None),
        ("PS5 (US Plug)", "PS5 us version", None), ("PS5 (US Plug)", "PS5 ( US", None), ("PS5 (US Plug)", None, "US Plug"),
        ("PS5 (US Plug)", "PS5 (USA)", "US Plug"), ("Falcon 75192", "Falcon", None), ("Airwrap (220-240V EU Spec)", "(EU)", None),
    ]
    got = evaluate(lambda d: style.region_mismatch(d.t, d.n), "t string, n string", [p[:2] for p in pairs])
    assert got == [p[2] for p in pairs]


def test_prefixed_skus(evaluate):
    cases = {
        "NIDM0113-100": "DM0113-100", "NIIQ0886-010": "IQ0886-010", "AAHQ2010-005": "HQ2010-005", "NIDM0113": "DM0113",
        "WKMKINK": "WKMKINK", "NS27023142-PIN": "NS27023142-PIN", "nidm0113-100": "DM0113-100", "": None, "   ": None,
    }
    assert evaluate(lambda d: style.style_from_prefixed_sku(d.s), "s string", [(k,) for k in cases]) == list(cases.values())
    sizes = {"NIDM0113-100/38,5": "38.5", "NIDM0113-100/42": "42", "NIDM0113-100": None, "": None, "WKMKINK/10EUR": "10EUR"}
    assert evaluate(lambda d: style.size_from_slashed_sku(d.s), "s string", [(k,) for k in sizes]) == list(sizes.values())
    eu = [("103181-36", "103181", "36"), ("103181-36-5", "103181", "36.5"), ("103181-36", "103181-36", "36"),
          ("103181-XL", "103181", None), ("103181", "103181", None), ("103181-365", "103181", None)]
    got = evaluate(lambda d: style.eu_size_from_sku(d.o, d.p), "o string, p string", [e[:2] for e in eu])
    assert got == [e[2] for e in eu]


def test_sizes_equal(evaluate):
    cases = [
        ("2XL", "2XS", False), ("2XL", "2", False), ("Large", "L", True), ("2XL", "XXL", True), ("EU 44", "44", True),
        ("44,5", "44.5", True), ("44 2/3", "44", False), ("44⅔", "44 2/3", True), ("FOO", "BAR", False), ("FOO", "FOO", False),
        ("S", "M", False), ("44.67", "44 2/3", False), ("44 1/0", "44", True), ("one size", "OSFA", True), ("8½", "8.5", True),
        ("Men's 9", "9", True), ("", "", False), (None, "9", False),
    ]
    got = evaluate(lambda d: size.sizes_equal(d.a, d.b), "a string, b string", [c[:2] for c in cases])
    assert got == [c[2] for c in cases]


def test_size_confidence(evaluate):
    cases = [
        ("8.5", None, "8.5", None, 1.0), ("8.5", "42", "8.5", "42.5", 0.5), ("8.5", None, "9", None, 0.0),
        (None, "42.5", None, "42.5", 1.0), (None, "42.5", None, "43", 0.0), (None, None, None, None, 0.0),
        ("8.5", "42", "9", "42", 0.0), ("8.5", "42", None, "42", 1.0), ("", "42", "9", "42", 1.0), ("8.5", "42", "8.5", "", 1.0),
        (" ", None, "9", None, 0.0),
    ]
    got = evaluate(
        lambda d: size.size_confidence(d.a, d.b, d.c, d.e), "a string, b string, c string, e string", [c[:4] for c in cases]
    )
    assert got == [c[4] for c in cases]


def test_size_routing_and_conversion(evaluate):
    rows = [("US", "8", "8"), ("US", "8", None), ("EU", "42", "8.5"), ("UK", "8", None), ("letter", "M", ""), (None, "8", "9")]
    schema = "s string, l string, u string"
    assert evaluate(lambda d: size.retail_us_label(d.s, d.l, d.u), schema, rows) == ["8", "8", "8.5", None, "M", "9"]
    assert evaluate(lambda d: size.retail_eu_label(d.s, d.l), schema, rows) == [None, None, "42", None, None, None]
    maps = [({"eu": "42", "eu w": "40"},), ({"eu": "", "eu m": "44"},), ({"eu w": "40"},), ({"uk": "8"},), ({},)]
    assert evaluate(lambda d: size.eu_conversion(d.m), "m map<string,string>", maps) == ["42", "44", "40", None, None]


def test_text_helpers(evaluate):
    got = evaluate(lambda d: F.array_sort(text.tokens(d.t)), "t string", [("The Nike Air-Max 1 Retro shoes AIR",), ("",)])
    assert got == [["air", "max", "nike"], []]
    pairs = [("LEGO", "LEGO", True), ("lego", "LEGO Star Wars", True), ("LEGO", "Pokemon", False), (None, "LEGO", False), ("", "LEGO", False), ("  ", "  ", False)]
    assert evaluate(lambda d: text.brands_agree(d.a, d.b), "a string, b string", [p[:2] for p in pairs]) == [p[2] for p in pairs]
    names = {
        "LEGO Technic Bugatti Bolide 42151": "42151", "lego-botanicals-roosa-lillekimp-10342": "10342",
        "Lego City. Päästemeeskonna seiklus": None, "lego-advendikalender-disney-animation-2025": None,
        "LEGO Icons 1998 Retro": None, "lego-icons-1998-retro-42151": "42151", "LEGO Technic 42115 Sian 3696 pieces": "42115",
        "x 1234567 y": None,
    }
    assert evaluate(lambda d: text.set_number(d.n), "n string", [(n,) for n in names]) == list(names.values())
    raw = [("JORDAN 1 &amp;quot;low&amp;quot;",), ("it's o'neill",), ("“AIR” max-90",)]
    assert evaluate(lambda d: text.display_name(d.n), "n string", raw) == ["Jordan 1 Low", "It'S O'Neill", "Air Max-90"]


def test_to_double(evaluate):
    raw = [("12.5",), (" 7 ",), ("",), ("null",), ("1e3",), ("12,5",), ("1.0d",), ("abc",), (None,), ("-3.",), (".5",)]
    assert evaluate(lambda d: text.to_double(d.s), "s string", raw) == [12.5, 7.0, None, None, 1000.0, None, None, None, None, -3.0, 0.5]


def test_barcodes(evaluate):
    raw = [("4006381333931",), ("40-0638.1 3",), ("1234567",), (None,), ("  ",)]
    assert evaluate(lambda d: barcode.clean_gtin(d.s), "s string", raw) == ["4006381333931", "40063813", None, None, None]


def test_times(spark):
    row = spark.sql("SELECT timestamp'2026-08-10 00:00:00' AS d, timestamp'2026-08-10 14:00:00' AS t").select(
        times.deadline(F.col("d")).cast("string").alias("a"), times.deadline(F.col("t")).cast("string").alias("b"),
        times.iso_time(F.lit("nonsense")).alias("c"), times.iso_time(F.lit("2026-08-10T00:00:30+00:00")).alias("e"),
        times.is_fresh(F.col("d"), F.col("t"), F.lit(840)).alias("f"), times.is_fresh(F.col("d"), F.col("t"), F.lit(839)).alias("g"),
        times.is_fresh(F.lit(None).cast("timestamp"), F.col("t"), F.lit(1)).alias("h"),
    ).first()
    assert (row.a, row.b, row.c) == ("2026-08-10 23:59:59", "2026-08-10 14:00:00", None)
    assert row.e is not None and (row.f, row.g, row.h) == (True, False, False)


# -- money ----------------------------------------------------------------------------

ROUND = cfg.FeeConfig(transaction_fee_pct=0.10, processing_fee_pct=0.03, min_transaction_fee=0.0, shipping=7.0)
NO_VAT = cfg.VatConfig()


def test_hand_computed_fees(evaluate):
    [b] = evaluate(lambda d: money.fee_breakdown("sell_now", d.s, d.c, ROUND, NO_VAT), "s double, c double", [(200.0, 100.0)])
    assert (b.transaction_fee, b.processing_fee, b.payout, b.profit) == (20.0, 6.0, 167.0, 67.0)
    assert b.margin_pct == pytest.approx(0.67) and b.roic == pytest.approx(67 / 107)


def test_minimum_fee_and_free_item(evaluate):
    fees = cfg.FeeConfig(0.09, 0.03, 5.0, 7.0)
    low, free = evaluate(lambda d: money.fee_breakdown("x", d.s, d.c, fees, NO_VAT), "s double, c double", [(40.0, 20.0), (40.0, 0.0)])
    assert low.transaction_fee == 5.0 and low.payout == pytest.approx(26.8)
    assert free.margin_pct == 0.0


def test_vat_both_sides(evaluate):
    vat = cfg.VatConfig(True, 0.24, True, True)
    [w] = evaluate(lambda d: money.vat_wedge(d.s, d.c, vat), "s double, c double", [(200.0, 100.0)])
    assert w == pytest.approx(100 * 0.24 / 1.24)
    assert evaluate(lambda d: money.vat_wedge(d.s, d.c, NO_VAT), "s double, c double", [(200.0, 100.0)]) == [0.0]


def test_scenarios(evaluate):
    fees = cfg.FeeConfig(undercut=5.0)
    rows = [(None,), (0.0,), (-1.0,), (150.0,), (3.0,)]
    bid = evaluate(lambda d: money.sell_now(d.x, F.lit(10.0), fees, NO_VAT)["sale_price"], "x double", rows)
    ask = evaluate(lambda d: money.list_ask(d.x, F.lit(10.0), fees, NO_VAT)["sale_price"], "x double", rows)
    assert bid == [None, None, None, 150.0, 3.0] and ask == [None, None, None, 145.0, 0.0]


def test_score(evaluate):
    rows = [(10.0, 1.0, None, 5.0), (10.0, -1.0, None, 5.0), (10.0, None, None, None), (10.0, -1.0, 5, 5.0), (10.0, -1.0, 99, 5.0), (10.0, -1.0, 0, 0.0)]
    got = evaluate(lambda d: money.opportunity_score(d.g, d.p, d.s, d.b), "g double, p double, s int, b double", rows)
    assert got == [20.0, 10.0, 5.0, 15.0, 20.0, 10.0]


def test_days_to_clear(evaluate):
    rows = [(3, 10), (None, 10), (0, 10), (3, None), (2, 0)]
    assert evaluate(lambda d: money.days_to_clear(d.s, d.a), "s int, a int", rows) == [10.0, None, None, 1.0, 1.5]


def test_landed_cost_stacks(evaluate):
    rows = [(100.0, 0.10, 0.15, 8.0, True), (100.0, 0.10, 0.15, 8.0, False), (100.0, 0.0, 0.0, 0.0, None)]
    got = evaluate(lambda d: money.landed_cost(d.p, d.d, d.s, d.o, d.e), "p double, d double, s double, e double, o boolean", rows)
    assert got == [pytest.approx(84.5), pytest.approx(98.0), 100.0]


def test_second_venue(evaluate):
    venue = cfg.SecondVenueConfig(commission_pct=0.1, cashout_pct=0.0, seller_fee=5.0, shipping=5.0)
    assert evaluate(lambda d: money.second_venue_payout(d.x, venue), "x double", [(100.0,)]) == [80.0]
    assert evaluate(lambda d: money.second_venue_breakeven(d.x, venue), "x double", [(80.0,)]) == [100.0]
    greedy = cfg.SecondVenueConfig(commission_pct=1.0)
    assert evaluate(lambda d: money.second_venue_breakeven(d.x, greedy), "x double", [(80.0,)]) == [None]


def test_keys(evaluate):
    rows = [("shop", "v1", "42"), ("shop", "v1", None), ("shop", "v1", "")]
    assert evaluate(lambda d: money.opportunity_key(d.a, d.b, d.c), "a string, b string, c string", rows) == ["shop|v1|42", "shop|v1", "shop|v1"]


def test_rounding_is_python_rounding(evaluate):
    rnd = random.Random(7)
    values = [2.675, 1.005, 0.125, 0.375, -0.125, 2.5, -2.5, 0.0, 1e-20, 123456.785, 8.345, 0.05, 0.25, 0.35]
    values += [rnd.uniform(-500, 500) for _ in range(400)] + [rnd.randint(-4000, 4000) / 8 for _ in range(200)]
    for digits in (1, 2):
        got = evaluate(lambda d: money.round_half_even(d.x, digits), "x double", [(x,) for x in values])
        assert got == [round(x, digits) for x in values]


def test_liquidity(evaluate):
    rows = [(None, None), (0, 5), (2, 0), (2, None)]
    def run(**kw):
        return evaluate(lambda d: money.liquidity_ok(d.b, d.s, cfg.FilterConfig(**kw)), "b int, s int", rows)
    assert run(min_bids=1) == [True, False, True, True]
    assert run(min_bids=1, min_sales_72h=1, strict_liquidity=True) == [False, False, False, False]
    assert run(min_bids=1, strict_liquidity=True) == [False, False, True, True]


def test_config_from_mapping():
    built = cfg.from_mapping({"filters": {"min_profit": 3.0}, "retailers": {"a": {"discount_pct": 0.1, "slug_filters": ["x"]}}})
    assert built.filters.min_profit == 3.0 and built.retailers[0].slug_filters == ("x",)
    with pytest.raises(ValueError):
        cfg.from_mapping({"filters": {"nope": 1}})


def test_entities_decode_as_in_html(evaluate):
    import html

    texts = ["a &amp; b", "&lt;&gt;&quot;&#39;&#x27;&apos;", "&auml;&Auml;&#228;&#xe4;&#XE4", "&#0;&#128;&#150;&#x110000;&#55296;&#1;&#127;&#64976;",
             "&notit; &ampx &nosuch; & &; &#; &#x; &#99999999999999;", "&eacute&nbsp", "&#x1F600;&CounterClockwiseContourIntegral;", "plain", "",
             "&amp;amp;", "&#65534;&#x1FFFF;&#11;&#13;&#000065;"]
    assert evaluate(lambda df: text.html_unescape(F.col('c')), "c string", [(t,) for t in texts]) == [html.unescape(t) for t in texts]
