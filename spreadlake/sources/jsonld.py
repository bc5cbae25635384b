"""schema.org products embedded in pages as JSON-LD."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions import style, text
from spreadlake.functions.barcode import clean_gtin
from spreadlake.functions.binding import evaluated_once
from spreadlake.sources import jsonvalue as jv
from spreadlake.session import materialize
from spreadlake.sources.base import any_in_stock, as_listing, extractor, size_struct

# How a page marks its blocks.
SCRIPT = r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
ANY_SCRIPT = r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"

# Keys under which further nodes sit, in reading order.
NESTING_KEYS = ("@graph", "mainEntity", "itemListElement")

# List and object steps followed in one pass over the pages.
STEPS = 8

# Barcode fields by trust.
GTIN_FIELDS = ("gtin13", "gtin12", "gtin14", "gtin", "gtin8")


def blocks(body: Column, pattern: str = SCRIPT) -> Column:
    """Parsed JSON-LD blocks of a page; unreadable ones are left out."""
    raw = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(pattern), F.lit(1))
    return F.filter(F.transform(raw, lambda b: F.try_parse_json(F.trim(b))), lambda v: v.isNotNull())


def _is_product(node: Column) -> Column:
    kinds = jv.get(node, "$['@type']", "array<string>")
    return F.coalesce(F.array_contains(kinds, "Product"), jv.text(node, "$['@type']") == "Product", F.lit(False))


def _entry(path: Column, node: Column) -> Column:
    return F.struct(path.alias("path"), node.alias("node"))


def _inside(entry: Column) -> Column:
    listed = F.transform(
        jv.items(entry["node"]),
        lambda x, i: _entry(F.concat(entry["path"], F.array(i)), x),
    )
    keyed = F.array(
        *[
            _entry(F.concat(entry["path"], F.array(F.lit(i))), jv.get(entry["node"], f"$['{key}']"))
            for i, key in enumerate(NESTING_KEYS)
        ]
    )
    return F.coalesce(listed, F.filter(keyed, lambda e: e["node"].isNotNull()))


def _walked(pages: DataFrame, columns: list[str]) -> DataFrame:
    """One pass: `_hits` gains the Product nodes on `_level0` and the steps below it,
    and `_level0` becomes what lies below those."""
    level = pages
    for d in range(STEPS):
        level = level.withColumn(f"_level{d + 1}", F.flatten(F.transform(f"_level{d}", _inside)))
    every = F.concat(*[F.col(f"_level{d}") for d in range(STEPS)])
    walked = F.struct(
        F.concat("_hits", F.filter(every, lambda e: _is_product(e["node"]))).alias("_hits"),
        F.col(f"_level{STEPS}").alias("_level0"),
    )
    return evaluated_once(level, "_walked", walked).select(*columns, "_walked.*")


def with_products(pages: DataFrame, body: str = "body") -> DataFrame:
    """The columns of `pages` but for the body, and `products`, every Product node of the
    page in document order, however deep it lies. Bodies are read once and never written:
    passes work on the open nodes of a page, and only pages with nodes below the steps of
    a pass go through another one."""
    kept = [c for c in pages.columns if c != body]
    start = F.transform(blocks(F.col(body)), lambda v, i: _entry(F.array(i), v))
    opened = pages.select(*kept, start.alias("_level0"))
    rest = opened.withColumn("_hits", F.filter("_level0", lambda e: F.lit(False)))
    done = []
    while True:
        walked = materialize(_walked(rest, kept))
        done.append(walked.filter(F.size("_level0") == 0))
        rest = walked.filter(F.size("_level0") > 0)
        if rest.isEmpty():
            break
    hits = F.array_sort(
        "_hits", lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    every = reduce(DataFrame.unionByName, done)
    return every.select(*kept, F.transform(hits, lambda e: e["node"]).alias("products"))


def with_top_product(pages: DataFrame, body: str = "body") -> DataFrame:
    """Add `node`: the first block, or list element of a block, that is a
    Product itself. Pages without one are dropped."""
    tops = F.flatten(F.transform(blocks(F.col(body), ANY_SCRIPT), jv.as_list))
    hit = F.filter(tops, lambda v: jv.is_object(v) & (jv.text(v, "$['@type']") == "Product"))
    return evaluated_once(pages, "node", F.get(hit, F.lit(0))).filter(F.col("node").isNotNull())


# -- fields of one product node -------------------------------------------------

def offer(item: Column) -> Column:
    """The first offer object, whether offers is one object or a list."""
    offers = jv.get(item, "$.offers")
    return F.get(F.filter(jv.as_list(offers), jv.is_object), F.lit(0))


def gtin_of(item: Column) -> Column:
    return F.coalesce(*[clean_gtin(jv.text(item, f"$.{name}")) for name in GTIN_FIELDS])


def brand_of(item: Column) -> Column:
    brand = jv.get(item, "$.brand")
    return text.blank_to_null(
        F.when(jv.is_object(brand), jv.text(brand, "$.name")).when(jv.is_text(brand), jv.text(brand))
    )


def price_of(item: Column) -> Column:
    value = text.to_double(F.replace(jv.text(offer(item), "$.price"), F.lit(","), F.lit(".")))
    return F.when(value > 0, value)


def in_stock(item: Column) -> Column:
    availability = F.coalesce(jv.text(offer(item), "$.availability"), F.lit(""))
    return availability.contains("InStock") | availability.contains("PreOrder")


def first_offer(node: Column) -> Column:
    """Price, currency and stock of the first offer whose price is a number."""
    read = F.transform(
        jv.as_list(jv.get(node, "$.offers")),
        lambda o: F.struct(
            text.to_double(jv.text(o, "$.price")).alias("price"),
            jv.text(o, "$.priceCurrency").alias("currency"),
            _offer_in_stock(o).alias("in_stock"),
        ),
    )
    return F.get(F.filter(read, lambda o: o["price"].isNotNull()), F.lit(0))


def _offer_in_stock(o: Column) -> Column:
    return F.lower(F.coalesce(jv.text(o, "$.availability"), F.lit(""))).contains("instock")


def page_offer(pages: DataFrame) -> DataFrame:
    """Page confirmation from one JSON-LD offer: price, currency, stock."""
    found = evaluated_once(with_top_product(pages), "o", first_offer(F.col("node"))).filter(F.col("o").isNotNull())
    return found.select("retailer", "url", "fetched_at", "o.price", "o.currency", "o.in_stock")


# -- extractors -----------------------------------------------------------------

def _priced_offers(kind) -> Column:
    """Offers with a numeric price, each turned into a struct by `kind`."""
    priced = F.filter(
        jv.as_list(jv.get(F.col("node"), "$.offers")),
        lambda o: text.to_double(jv.text(o, "$.price")).isNotNull(),
    )
    return F.transform(priced, kind)


def _currency() -> Column:
    first = F.get(jv.as_list(jv.get(F.col("node"), "$.offers")), F.lit(0))
    return F.coalesce(text.empty_to_null(jv.text(first, "$.priceCurrency")), F.lit("EUR"))


def _lowest(offers: str) -> Column:
    return F.array_min(F.transform(offers, lambda o: o["price"]))


@extractor("jsonld_us_sizes")
def us_size_offers(pages: DataFrame) -> DataFrame:
    """Per-size offers whose SKU ends in the US size; the listing price is the
    lowest offer."""

    def read(o: Column) -> Column:
        us = text.first_group(F.coalesce(jv.text(o, "$.sku"), F.lit("")), r"[-_]([0-9]{1,2}(?:\.5)?)$")
        name = F.coalesce(text.empty_to_null(jv.text(o, "$.name")), F.lit("?"))
        return F.struct(
            text.to_double(jv.text(o, "$.price")).alias("price"),
            size_struct(
                F.coalesce(us, F.trim(F.substring_index(name, "-", -1))), "US", us,
                F.coalesce(text.empty_to_null(jv.text(o, "$.gtin12")), text.empty_to_null(jv.text(o, "$.gtin13"))),
                _offer_in_stock(o),
            ).alias("size"),
        )

    handle = text.last_segment(F.col("url"))
    sku = F.coalesce(jv.text(F.col("node"), "$.sku"), F.lit(""))
    by_sku = F.get(style.sku_candidates(F.replace(sku, F.lit("-"), F.lit("_"))), F.lit(0))
    by_handle = F.upper(text.first_group(handle, r"([a-z]{1,3}[0-9]{4,6}-[0-9]{3})$"))
    found = evaluated_once(with_top_product(pages), "_offers", _priced_offers(read)).filter(F.size("_offers") > 0)
    sizes = F.transform("_offers", lambda o: o["size"])
    brand = jv.get(F.col("node"), "$.brand")
    return as_listing(
        found,
        name=F.trim(F.coalesce(text.empty_to_null(jv.text(F.col("node"), "$.name")), handle)),
        brand=F.when(jv.is_object(brand), jv.text(brand, "$.name")).otherwise(jv.text(brand)),
        style_code=F.coalesce(by_sku, by_handle), price=_lowest("_offers"), currency=_currency(),
        sizes=sizes, in_stock=any_in_stock(sizes), price_verified=F.lit(True),
    )


@extractor("jsonld_eu_sizes")
def eu_size_offers(pages: DataFrame) -> DataFrame:
    """Per-size offers whose SKU ends in the EU size; the manufacturer code
    comes from the page text or its description, and without one the page is
    dropped as unmatchable."""
    parent = F.substring_index(F.coalesce(jv.text(F.col("node"), "$.sku"), F.lit("")), "-", 1)

    def read(o: Column) -> Column:
        label = style.eu_size_from_sku(F.coalesce(jv.text(o, "$.sku"), F.lit("")), F.col("_parent"))
        return F.struct(
            text.to_double(jv.text(o, "$.price")).alias("price"),
            size_struct(
                label, "EU", None,
                F.coalesce(text.empty_to_null(jv.text(o, "$.gtin13")), text.empty_to_null(jv.text(o, "$.gtin12"))),
                _offer_in_stock(o),
            ).alias("size"),
        )

    shown = F.regexp_replace("body", "<[^>]+>", " ")
    by_text = text.first_group(
        shown, r"(?i)Manufacturer-#\s*:?\s*([A-Z0-9]{4,12}(?:[ \-][A-Z0-9]{2,4})?)"
    )
    by_description = text.first_group(
        F.col("body"), r'og:description"\s+content="[^"]*?\|\s*([A-Z0-9]{4,12}(?:\s+[0-9]{3})?)\s*\|'
    )
    code = F.coalesce(
        F.regexp_replace(F.trim(by_text), "[ ]+", "-"), F.regexp_replace(F.trim(by_description), r"\s+", "-")
    )
    coded = evaluated_once(with_top_product(pages).withColumn("_parent", parent), "_code", F.upper(code))
    found = evaluated_once(coded.filter(F.col("_code").isNotNull()), "_offers", _priced_offers(read)).filter(
        F.size("_offers") > 0
    )
    sizes = F.filter(F.transform("_offers", lambda o: o["size"]), lambda s: s["label"].isNotNull())
    brand = jv.get(F.col("node"), "$.brand")
    name = F.coalesce(text.empty_to_null(jv.text(F.col("node"), "$.name")), text.last_segment(F.col("url")))
    return as_listing(
        found,
        name=F.trim(text.html_unescape(name)),
        brand=F.when(jv.is_object(brand), jv.text(brand, "$.name")).otherwise(jv.text(brand)),
        style_code=F.col("_code"), price=_lowest("_offers"), currency=_currency(),
        sizes=sizes, in_stock=any_in_stock(sizes), price_verified=F.lit(True),
    )


# Category words without a resale market.
SKIPPED_CATEGORY = r"(?iU)\b(books?|raamat|literature|magazine|stationery)\b"


def _first_product(pages: DataFrame) -> DataFrame:
    read = pages.select("retailer", "url", "fetched_at", "body")
    return with_products(read).select("*", F.get("products", F.lit(0)).alias("node")).filter(F.col("node").isNotNull())


def _page_url() -> Column:
    return F.coalesce(text.empty_to_null(jv.text(F.col("node"), "$.url")), F.col("url"))


@extractor("boxed_sets")
def boxed_sets(pages: DataFrame) -> DataFrame:
    """Sealed sets, identified by the set number in their name; books and
    anything without such a number are dropped."""
    node = F.col("node")
    name = F.trim(F.coalesce(jv.text(node, "$.name"), F.lit("")))
    kept = _first_product(pages).filter(
        ~F.coalesce(jv.text(node, "$.category"), F.lit("")).rlike(SKIPPED_CATEGORY)
    )
    named = evaluated_once(kept, "_name", name).withColumn("_code", text.set_number(F.col("_name")))
    priced = evaluated_once(
        named.filter(F.col("_code").isNotNull()), "_price", text.to_double(jv.text(offer(node), "$.price"))
    )
    found = priced.filter(F.col("_price") > 0)
    return as_listing(
        found, name=F.col("_name"), brand=text.first_word(F.col("_name")), style_code=F.col("_code"),
        category=F.lit("collectibles"), url=_page_url(), price=F.col("_price"),
        currency=F.coalesce(text.empty_to_null(jv.text(offer(node), "$.priceCurrency")), F.lit("EUR")),
        in_stock=in_stock(node), price_verified=F.lit(True), ean=gtin_of(node),
    )


@extractor("barcode_products")
def barcode_products(pages: DataFrame) -> DataFrame:
    """Products whose only key is a barcode; none or no price means dropped."""
    node = F.col("node")
    read = F.struct(gtin_of(node).alias("gtin"), price_of(node).alias("price"))
    found = evaluated_once(_first_product(pages), "_read", read).filter(
        F.col("_read.gtin").isNotNull() & F.col("_read.price").isNotNull()
    )
    offers = jv.get(node, "$.offers")
    currency = F.when(jv.is_object(offers), text.empty_to_null(jv.text(offers, "$.priceCurrency")))
    return as_listing(
        found, name=F.trim(F.coalesce(jv.text(node, "$.name"), F.lit(""))), brand=brand_of(node),
        category=F.lit("electronics"), url=_page_url(), price=F.col("_read.price"),
        currency=F.coalesce(currency, F.lit("EUR")), in_stock=in_stock(node),
        price_verified=F.lit(True), ean=F.col("_read.gtin"),
    )
