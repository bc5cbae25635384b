"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of both is rendered once, as the prompt; what follows it
in each is a completion. A side that would be left without a turn gets its last one
back. A turn is rendered as its role in a header, its text and an end mark. In a
completion only what an assistant says is learned: its text and the end mark, given as
spans of code points (end exclusive); all else is masked.

Defined cases: null roles and texts are empty; rows without a conversation or turn are
left out; repeated rows count once; rows that differ but share a turn follow one another
by role, then text; a pair with one side only has no prompt and null for the other
side; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.operators.ordered import RowNumber, with_ordered

HEADER, END = ("<|", "|>\n"), "<|end|>\n"
ASSISTANT = "assistant"
SPANS = "array<struct<start:bigint,end:bigint>>"


def turns(rows: DataFrame, key: str) -> DataFrame:
    """(key, turns): the turns of each conversation in order, as structs of role and text."""
    each = rows.filter(F.col(key).isNotNull() & F.col("turn").isNotNull()).select(
        key, "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_set(F.struct("turn", "role", "text")))
    return each.groupBy(key).agg(ordered.alias("t")).select(
        key, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(HEADER[0]), turn["role"], F.lit(HEADER[1]))


def rendered(some: Column) -> Column:
    return F.array_join(F.transform(some, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def learned(some: Column) -> Column:
    """Spans of the rendered turns that are not masked."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(_header(turn))
        end = begin + F.length(turn["text"]) + len(END)
        span = F.array(F.struct(begin.alias("start"), (end - 1).alias("end")))  # the last line break is no part of the mark
        out = F.when(turn["role"] == ASSISTANT, F.concat(state["out"], span)).otherwise(state["out"])
        return F.struct(end.cast("bigint").alias("at"), out.cast(SPANS).alias("out"))

    return F.aggregate(some, start, step)["out"]


def common_prefix(a: str, b: str) -> Column:
    """The number of turns that both columns of turns begin with."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(equal, False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b)).cast("bigint"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans); both
    inputs are (pair_id, turn, role, text)."""
    both = turns(chosen, "pair_id").withColumnRenamed("turns", "c").join(
        turns(rejected, "pair_id").withColumnRenamed("turns", "r"), "pair_id", "full")
    shortest = F.least(F.size("c"), F.size("r")).cast("bigint")
    found = both.withColumn("n_common", F.when(
        F.col("c").isNull() | F.col("r").isNull(), F.lit(0).cast("bigint")
    ).otherwise(F.least(common_prefix("c", "r"), shortest - 1)))

    def rest(side: str) -> Column:
        return F.slice(side, (F.col("n_common") + 1).cast("int"), F.greatest(F.size(side), F.lit(1)))

    prompt = F.slice(F.coalesce("c", "r"), F.lit(1), F.col("n_common").cast("int"))
    return found.select(
        "pair_id", "n_common", rendered(prompt).alias("prompt"),
        rendered(rest("c")).alias("chosen"), learned(rest("c")).alias("chosen_spans"),
        rendered(rest("r")).alias("rejected"), learned(rest("r")).alias("rejected_spans"),
    )


def paired_by_opening(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides of pairs from a table of conversations: those that open with the same
    turn are paired in the order of their ids, the earlier one chosen. The pair's id is
    that of the chosen one."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    opening = rows.groupBy("conv_id").agg(
        F.min(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("o")
    ).select("conv_id", F.sha2(F.concat_ws("\n", "o.role", "o.text"), 256).alias("opening"))
    numbered = with_ordered(opening, ["opening"], [F.col("conv_id")], n=RowNumber())
    pairs = numbered.withColumn("pair", F.floor((F.col("n") - 1) / 2))
    # a pair has two conversations at most, so a window over it is small
    first = pairs.groupBy("opening", "pair").agg(F.min("conv_id").alias("pair_id"), F.max("conv_id").alias("other"))
    chosen = first.select("pair_id", F.col("pair_id").alias("conv_id"))
    rejected = first.filter("other <> pair_id").select("pair_id", F.col("other").alias("conv_id"))
    return rows.join(chosen, "conv_id").drop("conv_id"), rows.join(rejected, "conv_id").drop("conv_id")
