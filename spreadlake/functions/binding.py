"""Naming a value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once. A long expression used several
    times would otherwise be repeated in the generated code, which has a size
    limit per method."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def evaluated_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections cannot inline. Catalyst
    moves a filter below the projection that computes its input and so computes
    it again; it does not move one below a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))
