"""A small end-to-end data set: one sized and one size-less offer that pay, one
that does not, and one whose region is not confirmed."""

from datetime import datetime, timezone

from spreadlake import schemas

NOW = datetime(2026, 8, 1, 12, 0, tzinfo=timezone.utc)


def size(label, us, stock, system="EU", ean=None):
    return (label, system, us, ean, stock)


def listing_rows():
    def row(retailer, name, brand, code, url, price, sizes, category=None, ean=None):
        return (retailer, name, brand, code, None, category, ean, None, url, price, "EUR", sizes, True, None,
                True, False, None, False, None, NOW)

    return [
        row("alpha", "Air Jordan 1 Low Se", "Jordan", "HQ2010-005", "https://alpha.example/aj1", 79.0,
            [size("42", "8.5", True), size("44", "10", True), size("45", "11", False)]),
        row("alpha", "Campus St", "adidas", "KJ1033", "https://alpha.example/campus", 110.0,
            [size("42", "8.5", True)]),
        row("boxes", "LEGO Star Wars Millennium Falcon 75192", "LEGO", "75192", "https://boxes.example/75192", 599.0,
            [], "collectibles"),
        row("volts", "Sony PlayStation 5 Pro 30th Anniversary", "Sony", "PS5PRO30TH", "https://volts.example/ps5",
            700.0, [], "electronics"),
    ]


CATALOG = [
    ("p-aj1", "HQ2010-005", "Jordan 1 Low SE Multicolor", "Jordan", "jordan-1-low-se", "men", 140.0, "sneakers", 1),
    ("p-campus", "KJ1033", "adidas Campus ST Grey", "adidas", "adidas-campus", "men", 120.0, "sneakers", 2),
    ("p-falcon", "", "LEGO Star Wars Millennium Falcon Ultimate Collector Series Set 75192", "LEGO",
     "lego-falcon", None, 849.99, "collectibles", 3),
    ("p-ps5", "", "Sony PlayStation 5 PS5 Pro 30th Anniversary PS5PRO30TH Bundle (US Plug)", "Sony",
     "sony-ps5", None, 799.99, "collectibles", 4),
]

VARIANTS = [
    ("p-aj1", "v-aj1-8.5", "8.5", "US", {"eu": "42", "us m": "8.5"}),
    ("p-aj1", "v-aj1-10", "10", "US", {"eu": "44", "us m": "10"}),
    ("p-aj1", "v-aj1-11", "11", "US", {"eu": "45", "us m": "11"}),
    ("p-campus", "v-campus-8.5", "8.5", "US", {"eu": "42", "us m": "8.5"}),
    ("p-falcon", "v-falcon", None, "US", {}),
    ("p-ps5", "v-ps5", None, "US", {}),
]


def quote_rows():
    def row(product, variant, ask, bid):
        return (product, variant, "EUR", ask, bid, None, None, None, None, None, NOW)

    return [
        row("p-aj1", "v-aj1-8.5", 165.0, 145.0), row("p-aj1", "v-aj1-10", None, None),
        row("p-aj1", "v-aj1-11", 150.0, 120.0), row("p-campus", "v-campus-8.5", 120.0, 95.0),
        row("p-falcon", "v-falcon", 900.0, 780.0), row("p-ps5", "v-ps5", 3301.0, 1984.0),
    ]


def tables(spark):
    from pyspark.sql import functions as F

    return {
        "listing": spark.createDataFrame(listing_rows(), schemas.LISTING).withColumn(
            "ordinal", F.monotonically_increasing_id()
        ),
        "catalog": spark.createDataFrame(CATALOG, schemas.CATALOG_PRODUCT),
        "variants": spark.createDataFrame(VARIANTS, schemas.CATALOG_VARIANT),
        "quotes": spark.createDataFrame(quote_rows(), schemas.QUOTE),
    }
