"""String helpers shared by matching and extraction. Column in, Column out."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, functions as F

from spreadlake.functions.binding import bind

# Words that say nothing about which product is meant.
STOP_TOKENS = ("the", "and", "for", "shoes", "shoe", "sneakers", "retro")

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def blank_to_null(c: Column) -> Column:
    """Empty text and NULL both mean "missing"."""
    return F.nullif(F.trim(c), F.lit(""))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def to_double(c: Column) -> Column:
    """Number text to double; anything else is unknown, never zero."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or NULL where there is no match."""
    return empty_to_null(F.regexp_extract(c, pattern, group))


def all_groups(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def tokens(c: Column) -> Column:
    """Distinct lower-case word tokens of two or more characters."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: F.length(w) > 1)
    stop = F.array(*[F.lit(w) for w in STOP_TOKENS])
    return F.array_except(kept, stop)


def first_word(c: Column) -> Column:
    """First whitespace-separated word, or NULL."""
    return empty_to_null(F.split(F.trim(c), r"(?U)\s+")[0])


def brand_key(c: Column) -> Column:
    """Brands agree when their first words do, whatever the case."""
    return F.lower(first_word(c))


def brands_agree(a: Column, b: Column) -> Column:
    return F.coalesce(brand_key(a) == brand_key(b), F.lit(False))


def set_number(name: Column) -> Column:
    """First run of 4 to 6 digits that is not a year of 19xx or 20xx."""
    runs = F.regexp_extract_all(name, F.lit(r"(?<![0-9])([0-9]{4,6})(?![0-9])"), F.lit(1))
    return F.get(F.filter(runs, lambda r: ~r.rlike("^(19|20)[0-9]{2}$")), F.lit(0))


def contains_any(c: Column, needles: list[str] | tuple[str, ...]) -> Column:
    if not needles:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def slug_wanted(slug: Column, wanted: list[str] | tuple[str, ...]) -> Column:
    """Allow-list of substrings; an empty list allows everything."""
    return contains_any(slug, wanted) if wanted else F.lit(True)


def path_allowed(url: Column, denied: list[str] | tuple[str, ...]) -> Column:
    return ~contains_any(url, denied)


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


_ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_LONGEST_NAME = 32


def _names() -> Column:
    """All named entities of HTML, with the semicolon where they need one."""
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def _character(code: Column) -> Column:
    """The character of a number as browsers read it: the C1 range is Windows-1252,
    what is no character is replaced, and control characters are left out."""
    remapped = [bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0)]
    at = F.get(F.array(*[F.lit(c) for c in remapped]), (code - 0x80).cast("int"))
    control = (code.between(1, 8)) | (code == 0x0B) | (code.between(0x0E, 0x1F)) | (code == 0x7F)
    none = control | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
        .when(code.between(0x80, 0x9F), at).when(none, "").otherwise(plain)
    )


def _decoded(entity: Column) -> Column:
    """One entity, ampersand included; an unknown name keeps its text, but for the
    longest entity it begins with."""
    body = F.substring(entity, 2, 1 << 30)
    number = F.regexp_replace(body, "^#[xX]?0*|;$", "")
    hexadecimal = F.conv(F.when(F.length(number) <= 8, number), 16, 10).try_cast("bigint")
    decimal = F.when(F.length(number) <= 12, F.when(number == "", "0").otherwise(number)).try_cast("bigint")
    code = F.when(body.rlike("^#[xX]"), F.when(number == "", F.lit(0).cast("bigint")).otherwise(hexadecimal)).otherwise(decimal)
    names = _names()
    known = F.element_at(names, body)
    sizes = F.sequence(F.least(F.length(body), F.lit(_LONGEST_NAME)), F.lit(1))
    begins = F.get(F.filter(sizes, lambda n: F.element_at(names, F.substr(body, F.lit(1), n)).isNotNull()), F.lit(0))
    part = F.concat(F.element_at(names, F.substr(body, F.lit(1), begins)), F.substr(body, begins + 1))
    return F.when(body.startswith("#"), _character(code)).otherwise(F.coalesce(known, part, entity))


def html_unescape(c: Column) -> Column:
    """One pass of entity decoding, named and numeric; a doubly escaped entity needs a
    second pass, as in HTML."""
    def decoded(raw: Column) -> Column:
        between = F.split(raw, _ENTITY, -1)
        found = F.transform(F.regexp_extract_all(raw, F.lit(_ENTITY), F.lit(0)), _decoded)
        whole = F.array_join(F.zip_with(between, found, lambda b, e: F.concat(b, F.coalesce(e, F.lit("")))), "")
        return F.when(raw.contains("&"), whole).otherwise(raw)

    # the text stands in four places, and a second pass would put four first passes there
    return bind(c, decoded)


def title_case(c: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere.

    `initcap` starts a new word at spaces only, so the text is cut at each
    border between a non-letter and a letter first.
    """
    parts = F.split(F.lower(c), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(
        F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), ""
    )


def display_name(c: Column) -> Column:
    """Twice-unescaped, unquoted, title-cased page name."""
    return title_case(F.regexp_replace(html_unescape(html_unescape(c)), '["“”]', ""))
