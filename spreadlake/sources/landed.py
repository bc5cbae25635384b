"""Readers for landed input: pages, JSON feeds, tables; batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from spreadlake import schemas
from spreadlake.functions.binding import evaluated_once
from spreadlake.sources import jsonvalue as jv


# What a landed record must hold to be of use.
KEYS = ("retailer", "url")


def records(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = KEYS, stream: bool = False) -> DataFrame:
    """JSON lines read by a fixed schema, whatever was landed: the columns of `schema`, and

    * `_reason`: why the line is rejected (`not JSON`, `not an object`, `without <field>`
      for a required one that is missing or unreadable), NULL for a good one;
    * `_drifted`: fields that are set but cannot be read as their type; they are NULL, and
      the line stays unless they are required. A list or struct with one such part counts
      as a whole;
    * `_record`, `_file`: the line, and where it stands.

    Scalars are converted (a price may be text), fields of the schema that a line lacks are
    NULL, fields it has besides are ignored, blank lines are none. No line fails the read,
    and none is lost: each is either accepted or rejected. A stream reads files as they come.
    """
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path).select(F.col("value").alias("_record"), F.col("_metadata.file_path").alias("_file"))
    parsed = evaluated_once(lines.filter(F.trim("_record") != ""), "_json", F.try_parse_json("_record"))
    fields = StructType.fromDDL(schema).fields
    is_object = jv.is_object(F.col("_json"))

    def member(f) -> Column:
        path = f"$['{f.name}']"
        value = jv.get(F.col("_json"), path, f.dataType.simpleString())
        if isinstance(f.dataType, StringType):  # a list or an object is no text, though it can be shown as one
            value = F.when(~F.schema_of_variant(jv.get(F.col("_json"), path)).rlike("^(ARRAY|OBJECT)"), value)
        return F.when(is_object, value)

    def drifted(f) -> Column:
        raw = jv.get(F.col("_json"), f"$['{f.name}']")
        return F.when(is_object & raw.isNotNull() & ~F.is_variant_null(raw) & F.col(f.name).isNull(), F.lit(f.name))

    read = parsed.select("*", *[member(f).alias(f.name) for f in fields])
    reason = F.when(F.col("_json").isNull(), F.lit("not JSON")).when(~is_object, F.lit("not an object"))
    for name in required:
        reason = reason.when(F.col(name).isNull(), F.lit(f"without {name}"))
    return read.select(
        *[f.name for f in fields], reason.alias("_reason"), F.array_compact(F.array(*[drifted(f) for f in fields])).alias("_drifted"),
        "_record", "_file",
    )


def accepted(read: DataFrame) -> DataFrame:
    """The good records, as the schema has them."""
    return read.filter("_reason IS NULL").drop("_reason", "_drifted", "_record", "_file")


def rejected(read: DataFrame) -> DataFrame:
    """The lines that were not taken, as landed, to be kept for a look or another try."""
    return read.filter("_reason IS NOT NULL").select("_file", "_reason", "_record")


def landing_report(read: DataFrame) -> DataFrame:
    """(item, n): accepted lines, rejected ones by reason, and drifted fields of accepted
    lines by name; counted in one pass."""
    good = F.col("_reason").isNull()
    items = F.when(good, F.concat(F.array(F.lit("accepted")), F.transform("_drifted", lambda f: F.concat(F.lit("drifted "), f)))).otherwise(
        F.array(F.concat(F.lit("rejected: "), F.col("_reason"))))
    return read.select(F.explode(items).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def _landed(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    if fmt == "json":
        return accepted(records(spark, path, schema))
    return spark.read.schema(schema).format(fmt).load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed pages as a table: Parquet, or the good records of JSON lines."""
    return _landed(spark, path, fmt, schemas.RAW_PAGE)


def read_files_as_pages(spark: SparkSession, path: str, retailer: str) -> DataFrame:
    """One whole file per page; the file name stands for the url."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.lit(retailer).alias("retailer"),
        F.col("_metadata.file_path").alias("url"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.col("value").alias("body"),
    )


def read_listings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Listings already normalised by an earlier extraction job, in either form."""
    return _landed(spark, path, fmt, schemas.LISTING)


def stream_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A growing folder as a stream, with the schema fixed up front."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def newest_page(pages: DataFrame) -> DataFrame:
    """The last read of each url."""
    names = [c for c in pages.columns if c not in ("retailer", "url")]
    return pages.groupBy("retailer", "url").agg(
        F.max_by(F.struct(*names), F.struct("fetched_at", F.length("body"))).alias("_p")
    ).select("retailer", "url", "_p.*")
