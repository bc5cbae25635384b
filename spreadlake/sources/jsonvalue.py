"""Reading JSON whose shape varies, through the VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_STRING_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def text(v: Column, path: str = "$") -> Column:
    """A scalar as text; NULL for JSON null, lists and objects."""
    return F.try_variant_get(v, path, "string")


def items(v: Column) -> Column:
    """The elements of a list; NULL when it is not a list."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_text(v: Column) -> Column:
    return F.coalesce(F.startswith(F.to_json(v), F.lit('"')), F.lit(False))


def as_list(v: Column) -> Column:
    """A list as it is, anything else as a list of one, nothing as empty."""
    return F.when(v.isNull(), F.array().cast("array<variant>")).otherwise(F.coalesce(items(v), F.array(v)))


def truthy(v: Column) -> Column:
    """Set, and not an empty or zero value."""
    shown = F.to_json(v)
    return F.coalesce(~shown.isin("null", "false", '""', "0", "[]", "{}"), F.lit(False))


def first_text(v: Column) -> Column:
    """A scalar, or the first set element of a list, as trimmed text."""
    listed = F.get(F.filter(items(v), lambda x: truthy(x)), F.lit(0))
    return F.coalesce(F.trim(F.when(items(v).isNotNull(), text(listed)).otherwise(text(v))), F.lit(""))


def balanced(tail: Column) -> Column:
    """The JSON object a text starts with, up to its closing brace. Braces
    inside string literals do not count."""
    pieces = F.regexp_extract_all(tail, F.lit(_STRING_LITERAL + r'|[{}]|[^"{}]++'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        at = state["at"] + 1
        closed = (state["end"] == 0) & (piece == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(closed, at).otherwise(state["end"]).alias("end"))

    end = F.aggregate(pieces, start, step)["end"]
    return F.when(end > 0, F.array_join(F.slice(pieces, F.lit(1), F.greatest(end, F.lit(1))), ""))
