"""Manufacturer style codes: canonical form, candidates from a shop SKU, and
the keys under which a catalog product may be found."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spreadlake.functions.binding import bind
from spreadlake.functions.text import empty_to_null, first_group

# What counts as a size when it ends a SKU.
SHOE_SIZE = r"^[0-9]{1,2}(\.5)?$"
APPAREL_SIZE = r"(?i)^(2?X{0,3}S|S|M|L|X{1,3}L|2XL|3XL|4XL|OS|ONE|0)$"
SKU_END_MARK = "CNF"

# A title that names several garments sold together.
MULTI_ITEM = r"(?iU)\bsets?\b|\b\d\s*-?\s*piece\b|\btwo[- ]piece\b"

# Regions and the words that follow them in a title.
REGIONS = ("US", "EU", "UK", "AU", "JP", "KR", "CN")
_REGION_ALT = "|".join(REGIONS)
_REGION_WORD = "(?:Plug|Version|Spec)"
_VOLTAGE = r"(?:\d{3}-\d{3}V\s*)?"


def normalize_code(code: Column) -> Column:
    """Upper case, letters A-Z and digits only."""
    return F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")


def _last(parts: Column, back: int = 1) -> Column:
    return F.get(parts, F.size(parts) - F.lit(back))


def _drop(parts: Column, n: int) -> Column:
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.lit(n), F.lit(0)))


def sku_parts(sku: Column) -> Column:
    """SKU pieces between underscores or blanks, without the closing mark.
    Hyphens stay: a hyphenated code is one piece."""
    raw = F.filter(F.split(F.trim(sku), r"(?U)[_\s]+"), lambda t: t != "")
    return F.when(F.upper(_last(raw)) == SKU_END_MARK, _drop(raw, 1)).otherwise(raw)


def sku_candidates(sku: Column) -> Column:
    """Possible style codes inside a shop SKU, the most specific first."""
    listed = bind(bind(sku_parts(sku), _readings), _with_colour_dropped)
    return F.coalesce(
        F.transform(listed, lambda c: F.array_join(c, "-")), F.array().cast("array<string>")
    )


def _readings(parts: Column) -> Column:
    n = F.size(parts)
    last, before = _last(parts), _last(parts, 2)
    two_digits = "^[0-9]{2}$"
    none = F.lit(None).cast("array<string>")
    waist_length = F.when((n >= 3) & last.rlike(two_digits) & before.rlike(two_digits), _drop(parts, 2))
    letter = F.when((n >= 2) & last.rlike(APPAREL_SIZE), _drop(parts, 1))
    shoe = F.when((n >= 2) & last.rlike(SHOE_SIZE), _drop(parts, 1))
    shoe_twice = F.when(
        (n >= 3) & last.rlike(SHOE_SIZE) & before.rlike(SHOE_SIZE), _drop(parts, 2)
    )
    every = F.array(
        *[F.coalesce(c, none) for c in (waist_length, letter, shoe, shoe_twice)], parts
    )
    return F.array_distinct(F.filter(every, lambda c: c.isNotNull() & (F.size(c) > 0)))


def _with_colour_dropped(readings: Column) -> Column:
    coloured = F.filter(readings, lambda c: (F.size(c) >= 2) & _last(c).rlike("^[0-9]{3,4}$"))
    return F.array_distinct(F.concat(readings, F.transform(coloured, lambda c: _drop(c, 1))))


def lookup_codes(style_code: Column) -> Column:
    """Codes to try for a listing: the code itself when it is not among the
    derived candidates, then the candidates."""
    own = F.array_compact(F.array(empty_to_null(style_code)))
    derived = sku_candidates(F.coalesce(style_code, F.lit("")))
    return bind(derived, lambda d: F.concat(F.array_except(own, d), d))


def is_multi_item(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(MULTI_ITEM)


def catalog_keys(style_id: Column, title: Column) -> Column:
    """Normalised codes that identify a catalog product on their own.

    One code written several ways is one key. Several different codes are all
    keys when the title shows a single product; for a multi-item title, or no
    title, only the combined code is.
    """
    pieces = F.transform(F.split(F.coalesce(style_id, F.lit("")), "[/,]"), normalize_code)
    distinct = F.array_distinct(F.filter(pieces, lambda p: p != ""))
    combined = F.array(normalize_code(style_id))

    def keys(codes: Column) -> Column:
        return (
            F.when(F.size(codes) <= 1, codes)
            .when(title.isNotNull() & ~is_multi_item(title), F.array_union(combined, codes))
            .otherwise(combined)
        )

    return bind(distinct, keys)


def style_ids_match(code: Column, style_id: Column, title: Column) -> Column:
    want = normalize_code(code)
    return F.coalesce((want != "") & F.array_contains(catalog_keys(style_id, title), want), F.lit(False))


def title_codes(title: Column) -> Column:
    """Normalised whole title tokens long enough to identify a product."""
    found = F.regexp_extract_all(title, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-]*"), F.lit(0))
    return F.array_distinct(
        F.filter(F.transform(found, normalize_code), lambda t: F.length(t) >= 4)
    )


def code_in_title(code: Column, title: Column) -> Column:
    return F.coalesce(F.array_contains(title_codes(title), normalize_code(code)), F.lit(False))


def region_marker(title: Column) -> Column:
    """The region a title pins, such as "US Plug", or NULL."""
    return first_group(title, rf"(?iU)\(({_VOLTAGE}(?:{_REGION_ALT})\s*{_REGION_WORD})\)")


def region_mismatch(title: Column, retail_name: Column) -> Column:
    """The marker to refuse on, or NULL when it is safe: silence in the retail
    name is not agreement."""
    name = F.coalesce(retail_name, F.lit(""))
    stated = F.concat(
        F.regexp_extract_all(name, F.lit(rf"(?iU)\(\s*({_REGION_ALT})\b"), F.lit(1)),
        F.regexp_extract_all(name, F.lit(rf"(?iU)\b({_REGION_ALT})\s*{_REGION_WORD}\b"), F.lit(1)),
    )

    def refuse(marker: Column) -> Column:
        region = F.upper(F.regexp_extract(marker, rf"(?iU)^{_VOLTAGE}([A-Z]{{2}})", 1))
        agrees = F.array_contains(F.transform(stated, F.upper), region)
        return F.when(~F.coalesce(agrees, F.lit(False)), marker)

    return bind(region_marker(title), refuse)


# Two brand letters in front of a manufacturer code.
PREFIXED_CODE = r"^[A-Z]{2}([A-Z]{1,2}[0-9]{4,6}(?:-[0-9]{2,3})?)$"


def style_from_prefixed_sku(sku: Column) -> Column:
    """Strip a two-letter brand prefix only where the rest is still a code."""
    raw = F.upper(F.trim(sku))
    return empty_to_null(F.coalesce(first_group(raw, PREFIXED_CODE), raw))


def size_from_slashed_sku(sku: Column) -> Column:
    """The size after the last slash, decimal comma made a point."""
    label = F.replace(F.trim(F.substring_index(sku, "/", -1)), F.lit(","), F.lit("."))
    return F.when(sku.contains("/"), empty_to_null(label))


def eu_size_from_sku(offer_sku: Column, parent_sku: Column) -> Column:
    """"103181-36" is 36, "103181-36-5" is 36.5; anything else is no size."""
    cut = F.when(
        F.startswith(offer_sku, parent_sku),
        F.regexp_replace(offer_sku.substr(F.length(parent_sku) + 1, F.length(offer_sku)), "^-+", ""),
    )
    own = F.when(offer_sku.contains("-"), F.regexp_replace(offer_sku, "^[^-]*-", ""))
    tail = F.coalesce(empty_to_null(cut), own)
    return F.when(tail.rlike("^[0-9]{2}(-[0-9])?$"), F.replace(tail, F.lit("-"), F.lit(".")))
