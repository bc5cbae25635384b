"""Size labels as canonical keys, so that "same size" is an equality join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from spreadlake.functions.binding import bind
from spreadlake.functions.text import empty_to_null

# Apparel size words and the letter size they mean.
LETTER_SIZES = {
    "XXS": "XXS", "2XS": "XXS",
    "XS": "XS",
    "S": "S", "SMALL": "S",
    "M": "M", "MEDIUM": "M",
    "L": "L", "LARGE": "L",
    "XL": "XL", "1X": "XL",
    "XXL": "XXL", "2XL": "XXL", "2X": "XXL",
    "XXXL": "XXXL", "3XL": "XXXL", "3X": "XXXL",
    "OS": "OS", "ONE SIZE": "OS", "OSFA": "OS",
}

# Fraction glyphs spelled out.
FRACTIONS = {"⅓": " 1/3", "⅔": " 2/3", "½": " 1/2", "¼": " 1/4", "¾": " 3/4"}

_MIXED = r"([0-9]+)\s+([0-9])\s*/\s*([0-9])"


def letter_size(label: Column) -> Column:
    word = F.regexp_replace(F.upper(F.trim(label)), "[^A-Z0-9 ]", "")
    synonyms = F.create_map(*[F.lit(x) for pair in LETTER_SIZES.items() for x in pair])
    return F.try_element_at(synonyms, word)


def numeric_size(label: Column) -> Column:
    """First number in the label; "44 2/3" is a mixed fraction, not 44."""
    spelled = reduce(
        lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])),
        FRACTIONS.items(),
        F.replace(label, F.lit(","), F.lit(".")),
    )

    def read(text: Column) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(text, _MIXED, i).try_cast("double")

        # a zero denominator leaves the whole number
        fraction = F.coalesce(F.try_divide(part(2), part(3)), F.lit(0.0))
        plain = F.regexp_extract(text, r"[0-9]+(\.[0-9]+)?", 0).try_cast("double")
        return F.when(text.rlike(_MIXED), part(1) + fraction).otherwise(plain)

    return bind(spelled, read)


def size_key(label: Column) -> Column:
    """"L:XXL" or "N:44.5"; NULL for a label nobody can read, which therefore
    equals nothing."""
    return F.coalesce(
        F.concat(F.lit("L:"), letter_size(label)), F.concat(F.lit("N:"), numeric_size(label).cast("string"))
    )


def sizes_equal(a: Column, b: Column) -> Column:
    return F.coalesce(size_key(a) == size_key(b), F.lit(False))


def size_confidence(retail_us: Column, retail_eu: Column, variant_us: Column, variant_eu: Column) -> Column:
    """1.0 sure, 0.5 the EU label contradicts an equal US label, 0.0 no mapping.
    A US label known on both sides decides alone; EU never rescues it."""
    r_us, r_eu, v_us, v_eu = (empty_to_null(c) for c in (retail_us, retail_eu, variant_us, variant_eu))
    both_us = r_us.isNotNull() & v_us.isNotNull()
    both_eu = r_eu.isNotNull() & v_eu.isNotNull()
    return F.when(
        both_us, F.when(sizes_equal(r_us, v_us), fit_given_us(both_eu, sizes_equal(r_eu, v_eu))).otherwise(F.lit(0.0))
    ).otherwise(F.when(both_eu & sizes_equal(r_eu, v_eu), F.lit(1.0)).otherwise(F.lit(0.0)))


def fit_given_us(both_eu: Column, eu_equal: Column) -> Column:
    """Confidence once the US labels agree."""
    return F.when(both_eu & ~eu_equal, F.lit(0.5)).otherwise(F.lit(1.0))


def retail_us_label(system: Column, label: Column, us_size: Column) -> Column:
    """The US side of a retail size: given, or the label itself under US and
    letter sizing. UK and unknown systems are never guessed."""
    named = F.upper(F.trim(F.coalesce(system, F.lit(""))))
    given = empty_to_null(us_size)
    return F.when(named.isin("US", "LETTER"), F.coalesce(given, label)).otherwise(given)


def retail_eu_label(system: Column, label: Column) -> Column:
    return F.when(F.upper(F.trim(system)) == "EU", label)


def eu_conversion(conversions: Column) -> Column:
    """The EU size of a variant: plain EU, then women's, then men's."""
    return F.coalesce(*[empty_to_null(F.try_element_at(conversions, F.lit(k))) for k in ("eu", "eu w", "eu m")])
