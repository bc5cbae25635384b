"""Barcode text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_gtin(c: Column) -> Column:
    """Digits only; fewer than eight digits is no barcode."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) >= 8, digits)


def looks_like_ean(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^[0-9]{8,14}$"), F.lit(False))
