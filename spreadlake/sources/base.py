"""The listing contract every extractor fulfils, and the extractor registry.

An extractor is a function from landed pages to listings, applied with
`pages.transform(...)`. It works row by row with array functions, so a page
never needs a shuffle and the size of a group is the size of a page.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from spreadlake import schemas

EXTRACTORS: dict[str, Callable[..., DataFrame]] = {}

_DEFAULT_VALUES = {
    "currency": "EUR", "in_stock": True, "price_verified": False,
    "size_stock_unverified": False, "on_sale": False,
}


def extractor(name: str):
    def register(fn):
        EXTRACTORS[name] = fn
        return fn

    return register


@cache
def listing_fields() -> tuple[StructField, ...]:
    return tuple(StructType.fromDDL(schemas.LISTING).fields)


def as_listing(df: DataFrame, **values: Column) -> DataFrame:
    """Select the listing columns; absent ones get their default or NULL."""
    out = []
    for f in listing_fields():
        if f.name in values:
            c = values[f.name]
        elif f.name in ("retailer", "url"):
            c = F.col(f.name)
        elif f.name == "scraped_at":
            c = F.col("fetched_at")
        elif f.name in _DEFAULT_VALUES:
            c = F.lit(_DEFAULT_VALUES[f.name])
        elif f.name == "sizes":
            c = F.array()
        else:
            c = F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def size_struct(label: Column, system: Column | str, us_size: Column | None = None,
                ean: Column | None = None, in_stock: Column | None = None) -> Column:
    none = F.lit(None)
    system = F.lit(system) if isinstance(system, str) else system
    return F.struct(
        label.alias("label"),
        system.alias("system"),
        (none if us_size is None else us_size).cast("string").alias("us_size"),
        (none if ean is None else ean).cast("string").alias("ean"),
        (none if in_stock is None else in_stock).cast("boolean").alias("in_stock"),
    )


def any_in_stock(sizes: Column) -> Column:
    return F.coalesce(F.exists(sizes, lambda s: F.coalesce(s["in_stock"], F.lit(False))), F.lit(False))
