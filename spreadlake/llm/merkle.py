"""Merkle manifest of a dataset, with a proof for every row, on built-in expressions only.

Rows are leaves. The leaves of one source, in order, are the ranks 0, 1, 2, ... of a tree in
which every ARITY consecutive nodes get a parent, until one node is left: the source's
subroot. The subroots, in order of their sources, are the leaves of one more such tree,
whose last node is the root.

A node is labelled with the interval [low, high) of leaf ranks it covers, so that one node
is below another when its interval lies within the other's. The width of a node's interval
is known from its level, but for the last node, so the ancestors of one level are found by
an equality join on (tree, low divided by that width): a bucket holds one parent. Going up,
each level is one aggregation by bucket, of a third as many rows as the one before. Going
down, the digests that stand beside a node are what is left of its parent's interval when its
own is taken away; they are put before those of the parent, so that each node holds the
proof from itself to the root, and each leaf is touched once.

Ranks come from an ordered scan that cuts a large source into segments; no step holds more
than ARITY nodes, or one row for each segment, together.

Defined cases: a null column is written `-`; a row without a doc_id is a leaf, sorted before
the others of its source, and is not tampered with; the rows of a null source are one source;
repeated rows are leaves of their own, and as they are equal it makes no difference which is
which; rows that share a doc_id are ordered by their digests; a source of one row is its own
subroot, one source's subroot the root, and a proof of no siblings the digest of nothing; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.operators.ordered import RowNumber, with_ordered
from spreadlake.session import materialize

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

SIDES = "array<struct<left:string,right:string>>"


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def _field(value: Column) -> Column:
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    """Digest of a row: each field with its length in bytes, or `-` for a null."""
    return digest(F.concat(*[_field(row[f]) for f in FIELDS]))


def _tree_of(source: Column) -> Column:
    """A tree's name: never null, and sorted as sources are, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _grown(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From leaves (tree, low, digest, row), where `row` is what a leaf carries along: for
    each level the runs (tree, low, children) that got a parent, and of each tree the top
    (tree, level, digest, row), `row` being null above the leaves."""
    kind = leaves.schema["row"].dataType
    nodes, runs, tops = leaves.select("tree", "low", (F.col("low") + 1).alias("high"), "digest", "row"), [], []
    while True:
        bucket = F.floor(F.col("low") / F.lit(ARITY ** (len(runs) + 1)))
        run = materialize(
            nodes.groupBy("tree", bucket.alias("bucket"))
            .agg(F.sort_array(F.collect_list(F.struct("low", "high", "digest", "row"))).alias("children"))
            # a tree's first node without a neighbour is its only one: the top
            .withColumn("done", (F.col("bucket") == 0) & (F.size("children") == 1)))
        only = F.get("children", F.lit(0))
        tops.append(run.filter("done").select("tree", F.lit(len(runs)).alias("level"), only["digest"].alias("digest"), only["row"].alias("row")))
        open_ = run.filter("NOT done").select("tree", only["low"].alias("low"), "children")
        if open_.isEmpty():
            return runs, reduce(DataFrame.unionByName, tops)
        runs.append(open_)
        nodes = open_.select(
            "tree", "low", F.array_max("children.high").alias("high"),
            digest(F.array_join("children.digest", "")).alias("digest"), F.lit(None).cast(kind).alias("row"))


def _beside() -> Column:
    """What is left of a run's interval on either side of one child's, as digests."""
    own = F.col("child")

    def joined(inside) -> Column:
        return F.array_join(F.transform(F.filter("children", inside), lambda c: c["digest"]), "")

    return F.struct(
        joined(lambda c: c["high"] <= own["low"]).alias("left"), joined(lambda c: c["low"] >= own["high"]).alias("right"))


def _proved(runs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Leaves (digest, row, sides, upper): `sides` holds what stands beside a leaf and its
    ancestors, level by level, before the sides its tree's top has; `upper` is taken from
    the top. Tops are (tree, level, digest, row, sides, upper)."""
    kept = ["tree", "low", "digest", "row", "sides", "upper"]

    def of(level: int) -> DataFrame:
        return tops.filter(F.col("level") == level).withColumn("low", F.lit(0).cast("bigint")).select(kept)

    nodes = of(len(runs))
    for depth in reversed(range(len(runs))):
        # parent and run cover the same interval; the level and its beginning name it
        parents = nodes.select("tree", "low", "sides", "upper")
        split = runs[depth].join(parents, ["tree", "low"]).select("*", F.explode("children").alias("child"))
        nodes = split.select(
            "tree", F.col("child.low").alias("low"), F.col("child.digest").alias("digest"), F.col("child.row").alias("row"),
            F.concat(F.array(_beside()), "sides").alias("sides"), "upper").unionByName(of(depth))
    return nodes.select("digest", "row", "sides", "upper")


def manifest(docs: DataFrame, **also: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, sides, ...) of every row. `sides` is its proof; `also`
    are further columns, computed from the row and carried along."""
    fields = {f: F.col(f) for f in FIELDS}
    # the digests are written first: ranks are found by sampling, which would read the texts again
    rows = materialize(docs.select(
        _tree_of(F.col("source")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf(fields).alias("leaf"),
        *[c.alias(n) for n, c in also.items()]))
    names = ["doc_id", *also]
    ranked = with_ordered(rows, ["tree"], [F.col(c) for c in ("doc_id", "leaf", *also)], place=RowNumber())
    runs, tops = _grown(ranked.select(
        "tree", (F.col("place") - 1).alias("low"), F.col("leaf").alias("digest"), F.struct(*names).alias("row")))
    tops = materialize(tops)
    ordered = with_ordered(tops.select("tree", "level", "digest"), [], [F.col("tree")], place=RowNumber())
    upper_runs, root = _grown(ordered.select(
        F.lit("").alias("tree"), (F.col("place") - 1).alias("low"), "digest", F.struct(F.col("tree").alias("of")).alias("row")))
    none = F.array().cast(SIDES)
    sources = _proved(upper_runs, root.withColumns({"sides": none, "upper": F.struct(F.col("digest").alias("root"))}))
    above = materialize(sources.select(
        F.col("row.of").alias("tree"), "sides", F.struct(F.col("digest").alias("subroot"), F.col("upper.root").alias("root")).alias("upper")))
    proved = _proved(runs, tops.join(above, "tree"))
    return proved.select(
        "row.doc_id", F.col("digest").alias("leaf"), "upper.subroot", "upper.root", "sides", *[f"row.{n}" for n in also])


def folded(start: Column, sides: Column) -> Column:
    """The root that follows from a leaf and what stands beside it and its ancestors."""
    return F.aggregate(sides, start, lambda node, side: digest(F.concat(side["left"], node, side["right"])))


def proof(sides: Column) -> Column:
    """One digest of all that stands beside a leaf and its ancestors."""
    return digest(F.array_join(F.transform(sides, lambda s: F.concat(s["left"], s["right"])), ""))


def leaf_without_line_feeds() -> Column:
    """The leaf of a row whose text has lost its line feeds, where 2 divides the checksum of
    its id; the leaf it has otherwise."""
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    text = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return leaf({**{f: F.col(f) for f in FIELDS}, "text": text})
