"""Extraction on small payloads."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from spreadlake import schemas
from spreadlake.sources import base, feeds, jsonld, jsonvalue, landed, market, markup, sitemap

AT = datetime(2026, 8, 1, tzinfo=timezone.utc)
PAGE = "retailer string, url string, fetched_at timestamp, body string"


LINES = [
    '{"retailer":"s","url":"u1","price":10,"sizes":[{"label":"42","system":"EU","in_stock":"true"}]}',
    '{"retailer":"s","url":"u2","price":"12.5","sizes":[{"label":{}}],"new":{"a":[1]}}', '{"retailer":"s","url":null,"price":1}', '{"retailer":"s","url":["u"]}',
    '{"retailer":"s","url":"u3","price":"soon","in_stock":null,"scraped_at":"2026-08-01T00:00:00Z"}', "", "  ", "{}", "[]", "3", "null", '{"retailer":"s"', "plain text", "\u0000",
]


def _judged(df):
    return sorted((r._record, r.url, r.price, r._reason, tuple(r._drifted)) for r in df.collect())


WANTED = sorted([
    (LINES[0], "u1", 10.0, None, ()), (LINES[1], "u2", 12.5, None, ()), (LINES[2], None, 1.0, "without url", ()), (LINES[3], None, None, "without url", ("url",)),
    (LINES[4], "u3", None, None, ("price",)), ("{}", None, None, "without retailer", ()), *[(x, None, None, "not an object", ()) for x in ("[]", "3", "null")],
    *[(x, None, None, "not JSON", ()) for x in LINES[11:]],
])


@pytest.fixture
def landed_folder(tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text("\n".join(LINES[i::2]))
    return str(tmp_path)


def test_every_landed_line_is_accepted_or_rejected(spark, landed_folder):
    read = landed.records(spark, landed_folder, schemas.LISTING)
    assert _judged(read) == WANTED
    good = landed.read_listings(spark, landed_folder, "json")
    assert good.columns == [f.name for f in base.listing_fields()]
    rows = {r.url: r for r in good.collect()}
    assert set(rows) == {"u1", "u2", "u3"} and rows["u1"].sizes[0].in_stock is True and rows["u3"].scraped_at is not None
    bad = landed.rejected(read).collect()
    assert len(bad) + len(rows) == len([x for x in LINES if x.strip(" ")]) and {r._file[-6:] for r in bad} == {"0.json", "1.json"}
    report = {r["item"]: r.n for r in landed.landing_report(read).collect()}
    assert report == {"accepted": 3, "drifted price": 1, "rejected: not an object": 3, "rejected: not JSON": 3, "rejected: without url": 2, "rejected: without retailer": 1}


def test_an_empty_landed_folder(spark, tmp_path):
    (tmp_path / "0.json").write_text("")
    read = landed.records(spark, str(tmp_path), schemas.RAW_PAGE)
    assert read.collect() == [] and landed.landing_report(read).collect() == []
    assert landed.read_pages(spark, str(tmp_path), "json").columns == ["retailer", "url", "fetched_at", "body"]


def test_a_stream_of_landed_lines_is_judged_alike(spark, landed_folder, tmp_path_factory):
    got = []
    stream = landed.records(spark, landed_folder, schemas.LISTING, stream=True)
    query = stream.writeStream.foreachBatch(lambda b, _: got.extend(_judged(b))).trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path_factory.mktemp("checkpoint"))).start()
    query.awaitTermination(120)
    assert sorted(got) == WANTED


@pytest.fixture
def page(spark):
    def make(*bodies, retailer="shop", url="https://x.example/p/item-{}"):
        return spark.createDataFrame([(retailer, url.format(i), AT, b) for i, b in enumerate(bodies)], PAGE)

    return make


def _ld(*nodes):
    return "".join(f'<script type="application/ld+json">{n if isinstance(n, str) else json.dumps(n)}</script>' for n in nodes)


PRODUCT = {"@type": "Product", "name": "Bolide 42151", "category": "Toys", "gtin": "5702017424538",
           "offers": {"price": 54.99, "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}}


def test_products_at_any_depth_in_document_order(page):
    named = lambda n: {"@type": "Product", "name": n}
    body = _ld(
        "{broken", {"@type": "BreadcrumbList"}, [named("a"), {"@graph": [{"@type": "WebPage"}, named("b")]}],
        {"@type": ["Thing", "Product"], "name": "c", "mainEntity": {"itemListElement": [[named("d")], {"itemListElement": named("e")}]}},
        "3", "null", '"Product"',
    )
    out = jsonld.with_products(page(body, "", None)).orderBy("url").collect()
    names = [[json.loads(str(v.toJson()))["name"] for v in r.products] for r in out]
    assert names == [["a", "b", "c", "d", "e"], [], []]


@pytest.mark.parametrize("depth", [7, 8, 9, 40])
def test_products_below_one_pass_are_found(page, depth):
    deep = [{"@type": "Product", "name": "last"}, {"@type": "Product", "name": "first", "mainEntity": {"@type": "Product", "name": "second"}}][::-1]
    for _ in range(depth):
        deep = {"@graph": [deep]}
    rows = jsonld.with_products(page(_ld(deep), "no script")).collect()
    assert sorted([json.loads(str(v.toJson()))["name"] for v in r.products] for r in rows) == [[], ["first", "second", "last"]]


@pytest.mark.parametrize("depth", [1, 30])
def test_no_body_is_written(page, depth, monkeypatch):
    """Intermediate tables hold open nodes and hits, never the page they come from."""
    written = []
    write = jsonld.materialize
    monkeypatch.setattr(jsonld, "materialize", lambda df: written.append(write(df)) or written[-1])
    deep = {**PRODUCT, "mainEntity": None}
    for _ in range(depth):
        deep = {"@graph": [deep]}
    out = jsonld.with_products(page("<p>shown text</p>" + _ld(deep), "shown text only"))
    assert sorted(len(r.products) for r in out.collect()) == [0, 1]
    # 30 graphs are 60 steps of list and object
    assert len(written) == 1 + 2 * depth // jsonld.STEPS and "body" not in out.columns
    for t in written:
        assert "body" not in t.columns and not any("shown text" in str(r.asDict()) for r in t.select("retailer", "url", F.to_json("_hits")).collect())
    # a page that is done is not written again
    assert [t.count() for t in written] == [2] + [1] * (len(written) - 1)


def test_fields(spark, evaluate):
    def run(fn, *items):
        return evaluate(lambda d: fn(F.parse_json(d.j)), "j string", [(json.dumps(i),) for i in items])

    assert run(jsonld.gtin_of, {"gtin8": "12345678", "gtin13": "4006381333931"}, {"gtin": "12 34"}, {"gtin": 5702017424538}, {},
               {"gtin13": "1", "gtin14": "10012345678902"}) == ["4006381333931", None, "5702017424538", None, "10012345678902"]
    assert run(jsonld.brand_of, {"brand": {"name": " LEGO "}}, {"brand": "Sony"}, {"brand": " "}, {"brand": 3}, {}) == ["LEGO", "Sony", None, None, None]
    offers = [{"offers": {"price": "1,50"}}, {"offers": [3, {"price": 2}, {"price": 9}]}, {"offers": {"price": 0}}, {"offers": []}, {}]
    assert run(jsonld.price_of, *offers) == [1.5, 2.0, None, None, None]
    stock = [{"offers": {"availability": a}} for a in ("https://schema.org/PreOrder", "OutOfStock", None)]
    assert run(jsonld.in_stock, *stock) == [True, False, False]


def test_boxed_sets_and_barcodes(page):
    books = {**PRODUCT, "category": "Kids > Books"}
    nameless = {**PRODUCT, "name": "LEGO sticker album"}
    sets = jsonld.boxed_sets(page(_ld(PRODUCT), _ld(books), _ld(nameless), _ld({**PRODUCT, "offers": {"price": "x"}}))).collect()
    assert [(r.style_code, r.brand, r.price, r.ean, r.in_stock, r.sizes) for r in sets] == [("42151", "Bolide", 54.99, "5702017424538", True, [])]
    codes = jsonld.barcode_products(page(_ld({"@graph": [PRODUCT]}), _ld({**PRODUCT, "gtin": ""}))).collect()
    assert [(r.ean, r.style_code, r.category) for r in codes] == [("5702017424538", None, "electronics")]


LUNAR = {
    "sku": "805899_202", "name": "LUNAR", "stock_status": "IN_STOCK",
    "configurable_options": [{"attribute_code": "footwear_size", "values": [{"label": "42", "value_index": 6372}, {"label": "44,5", "value_index": 6377}]}],
    "variants": [{"product": {"sku": "a", "footwear_size": "6372", "stock_status": "IN_STOCK"}},
                 {"product": {"sku": "b", "footwear_size": "6377", "stock_status": "OUT_OF_STOCK"}}],
}


def _option_sizes(page, item):
    [r] = feeds.with_option_sizes(feeds.parse_items(page(json.dumps([item])))).collect()
    return {s.label: s.in_stock for s in r.option_sizes}, r.unresolved


def test_option_index_join(page):
    assert _option_sizes(page, LUNAR) == ({"42": True, "44.5": False}, False)
    stray = {**LUNAR, "variants": LUNAR["variants"] + [{"product": {"footwear_size": "9999", "stock_status": "IN_STOCK"}}]}
    assert _option_sizes(page, stray) == ({"42": True, "44.5": False}, True)
    assert _option_sizes(page, {**LUNAR, "variants": []}) == ({"42": None, "44.5": None}, True)
    assert _option_sizes(page, {**LUNAR, "variants": None, "configurable_options": None}) == ({}, True)


def test_walk_in_price_and_quantities(page, spark):
    item = {"title": "T", "product_code": " m9160c ", "in_stock": True, "brands": [{"title": "Nike"}],
            "prices": [{"type": "default", "value": 90}, {"type": "client_extra", "value": 1}, {"type": "sale", "value": 80.5}],
            "variations": [{"type": "size", "enabled": True, "value": "42", "ean": "4006381333931", "in_stock": True},
                           {"type": "size", "enabled": True, "value": "43", "in_stock": True}]}
    listing = feeds.product_api(page(json.dumps(item), json.dumps({**item, "archived_at": "2024"}), "not json"))
    [row] = listing.collect()
    assert (row.price, row.style_code, [s.label for s in row.sizes]) == (80.5, "M9160C", ["42", "43"])
    counts = [{"variation": {"value": "42"}, "quantity": 0}, {"variation": {"value": "42"}, "quantity": 0}]
    quantities = spark.createDataFrame([("shop", "https://x.example/p/item-0", json.dumps(counts))], "retailer string, url string, body string")
    [checked] = feeds.confirm_quantities(listing, quantities).collect()
    assert {s.label: s.in_stock for s in checked.sizes} == {"42": False, "43": True} and checked.in_stock


def test_balanced_object(evaluate):
    texts = {'{"a":{"b":"}"}} tail}': '{"a":{"b":"}"}}', '{"q":"\\"{"},{': '{"q":"\\"{"}', "{open": None, "": None}
    assert evaluate(lambda d: jsonvalue.balanced(d.t), "t string", [(t,) for t in texts]) == list(texts.values())


def test_final_price_takes_the_earlier_attribute_order(evaluate):
    bodies = [
        ('<i data-price-type="oldPrice" data-price-amount="9"><i data-price-type="finalPrice" data-price-amount="5.5">', 5.5),
        ('<i data-price-amount="7" data-price-type="finalPrice">', 7.0), ("none", None),
        ('<i data-price-amount="0" data-price-type="finalPrice">', None),
    ]
    assert evaluate(lambda d: markup.final_price(d.b), "b string", [(b,) for b, _ in bodies]) == [p for _, p in bodies]
    assert evaluate(lambda d: markup.labelled_style(d.b), "b string", [("Mudel: IF4396-103 x",), ("Tootekood  dq 1",)]) == ["IF4396-103", None]


def test_extractors_give_the_listing_schema(page):
    want = [(f.name, f.dataType) for f in base.listing_fields()]
    for name, extract in base.EXTRACTORS.items():
        rows = page("x")
        if name == "prefixed_items":
            rows = rows.withColumn("brand", F.lit("nike"))
        got = rows.transform(extract)
        assert [(f.name, f.dataType) for f in got.schema.fields] == want, name
        assert got.count() == 0, name


def test_rotation_wraps_and_never_repeats(spark):
    slugs = spark.createDataFrame([("s", f"p{i}", 0, i) for i in range(8)], "retailer string, slug string, ordinal int, pos int")

    def window(offset, n):
        offsets = spark.createDataFrame([("s", offset)], "retailer string, offset bigint")
        turned = sitemap.rotation_slice(slugs, offsets, n).orderBy("turn").collect()
        after = sitemap.next_offsets(slugs, offsets, n).first().offset
        return [r.slug for r in turned], after

    assert window(6, 4) == (["p6", "p7", "p0", "p1"], 2)
    assert window(3, 100) == (["p3", "p4", "p5", "p6", "p7", "p0", "p1", "p2"], 3)
    assert window(0, 0) == ([], 0)


def test_market_rows(spark):
    raw = json.dumps([{"variantId": "v1", "lowestAskAmount": "165", "highestBidAmount": None}, {"variantId": "v2", "lowestAskAmount": "", "highestBidAmount": "null"}, {"variantId": ""}])
    responses = spark.createDataFrame([("p", AT, raw)], "product_id string, fetched_at timestamp, body string")
    rows = market.quotes(responses)
    assert sorted((r.variant_id, r.lowest_ask, r.highest_bid) for r in rows.collect()) == [("v1", 165.0, None), ("v2", None, None)]
    assert [(r.variants, r.without_quote) for r in market.quote_gaps(rows).collect()] == [(2, 1)]


def test_whole_files_as_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text("<b>\n1</b>")
    rows = landed.read_files_as_pages(spark, str(tmp_path), "shop").collect()
    assert [r.body for r in rows] == ["<b>\n1</b>"] and rows[0].url.endswith("a.html")
