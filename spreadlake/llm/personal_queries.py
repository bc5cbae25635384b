"""The query of personal data. Added spans have no SQL form; the tests hold them and the base
spans against plain readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spreadlake.llm import personal
from spreadlake.llm.common import table


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in personal.KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def _number(spans: str, rank: int) -> Column:
    # a function of two arguments would be given a span's place as well
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, by pattern and by the trained field."""
    found = personal.scan(table(spark, sf_dir, "documents"))
    counts = [_number("base", rank).alias(f"n_{kind}") for rank, kind in enumerate(personal.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.sort_array(F.concat("base", "added"))).alias("spans"))
