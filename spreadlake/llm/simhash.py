"""SimHash near-dedup with BK-trees.

A fingerprint has 64 bits; bit i is set when it is set in over half of the XXH64
hashes (seed 42) of a document's word shingles. Documents link when their
fingerprints differ in at most `radius` bits, and a component is whatever links reach.

Equal fingerprints are one node. The others are searched in BK-trees: the children of
a tree node are keyed by their Hamming distance to it, and a search with distance d to
the node follows only the edges from d - radius to d + radius. A tree is built for each
shard. Sending every tree to every fingerprint would grow with the square of the
corpus, so shards are cut by content: of `radius + 1` blocks of bits two linked
fingerprints share one, so a fingerprint belongs to one shard for each block, and a
shard that is still large is cut the same way by its other bits. All links are found,
each inside some shard, and of a shard only a spanning forest of its links leaves the
task, never all its pairs.

Defined cases: null and blank texts have no shingle and fingerprint zero, which links
like any other; fewer words than a shingle make one shingle of all; rows without a
doc_id are left out; repeated rows are returned as often as they come; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from spreadlake.llm import common
from spreadlake.llm.components import components
from spreadlake.session import materialize

BITS = 64
SEED = 42
# A shard above this is cut once more, as long as it has bits left to cut by.
SHARD = 20_000
# Nodes under this are compared with each query directly.
LEAF = 16

PRINTS = "doc_id long, fp long"
EDGES = "a long, b long"


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles, in order and as often as they come."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array([digest(joined[a:b], seed) for a, b in
                     zip(start[: len(tokens) - words + 1].tolist(), stop[words - 1:].tolist(), strict=True)], dtype=np.uint64)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[at:at + 4096]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint(text: str | None, words: int) -> int:
    return _majority(shingles(text, words))


def _fingerprints(words: int):
    schema = common.schema_of(PRINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.tables_of(batches):
            prints = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            yield common.rows(schema, batch.column("doc_id"), np.array(prints, dtype=np.uint64).view(np.int64))

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long with the same bits."""
    return common.documents(docs).mapInArrow(_fingerprints(words), PRINTS)


def distances(x: np.ndarray, y: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ y)


class Tree:
    """A BK-tree over distinct fingerprints; nodes hold indexes into them."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.root = self._node(np.arange(len(prints)))

    def _node(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members
        pivot, rest = members[0], members[1:]
        d = distances(self.prints[rest], self.prints[pivot])
        return pivot, {int(k): self._node(rest[d == k]) for k in np.unique(d)}

    def links(self, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(member, members within the radius of it) so that each link comes at least once."""
        stack = [(self.root, np.arange(len(self.prints)))]
        while stack:
            node, asking = stack.pop()
            if isinstance(node, tuple):
                pivot, children = node
                d = distances(self.prints[asking], self.prints[pivot])
                yield pivot, asking[d <= radius]
                for edge, child in children.items():
                    near = asking[(d >= edge - radius) & (d <= edge + radius)]
                    if len(near):
                        stack.append((child, near))
            else:
                for member in node:
                    yield member, asking[distances(self.prints[asking], self.prints[member]) <= radius]


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of linked fingerprints that connect all that links connect, at most one
    fewer than there are fingerprints."""
    group = np.arange(len(prints))
    pairs = []
    for member, near in Tree(prints).links(radius):
        for other in np.unique(group[near]):
            if other != group[member]:
                pairs.append((member, near[group[near] == other][0]))
                group[group == other] = group[member]
    return pairs


def _linked(radius: int):
    """Rows sorted by shard; one shard is held at a time."""
    schema = common.schema_of(EDGES)

    def edges(prints: np.ndarray) -> list[tuple[int, int]]:
        if len(prints) == 2:
            return [(0, 1)] if int(distances(prints[:1], prints[1])[0]) <= radius else []
        return forest(prints, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.empty(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("block", "bits")]
            prints = batch.column("fp").to_numpy().view(np.uint64)
            cut = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
            starts, stops = np.r_[0, cut], np.r_[cut, len(prints)]
            a, b = [], []
            for i in np.flatnonzero((stops - starts > 1) | (starts == 0) | (stops == len(prints))):
                start, stop = starts[i], stops[i]
                key, part = (keys[0][start], keys[1][start]), prints[start:stop]
                if key == held_key:
                    part = np.r_[held, part]
                elif len(held) > 1:
                    for x, y in edges(held):
                        a.append(held[x]), b.append(held[y])
                held_key, held = None, np.empty(0, np.uint64)
                if stop == len(prints):
                    held_key, held = key, part
                elif len(part) > 1:
                    for x, y in edges(part):
                        a.append(part[x]), b.append(part[y])
            yield common.rows(schema, np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64))
        if len(held) > 1:
            pairs = edges(held)
            yield common.rows(schema, np.array([held[x] for x, _ in pairs], np.uint64).view(np.int64),
                              np.array([held[y] for _, y in pairs], np.uint64).view(np.int64))

    return run


def _cuts(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, c)) for c in np.array_split(np.array(bits), parts)]


def _shards(prints: DataFrame, radius: int) -> DataFrame:
    """(block, bits, fp): each fingerprint once for every shard it belongs to. A block
    is the mask of the bits a shard agrees on, `bits` their values."""
    parts = radius + 1

    def keyed(df: DataFrame, masks: list[int]) -> DataFrame:
        each = F.array(*[F.lit(_signed(m)) for m in masks])
        return df.select("fp", F.explode(each).alias("block")).select(
            "block", F.col("fp").bitwiseAND(F.col("block")).alias("bits"), "fp")

    todo = [(0, list(range(BITS)))]
    rows, done = None, []
    while todo:
        level = [(mask | sum(1 << i for i in cut), [i for i in free if i not in set(cut)], mask)
                 for mask, free in todo for cut in _cuts(free, parts)]
        if rows is None:
            rows = keyed(prints, [m for m, _, _ in level])
        else:
            of = {}
            for m, _, parent in level:
                of.setdefault(parent, []).append(m)
            rows = None if not of else _union([keyed(big.filter(F.col("block") == F.lit(_signed(p))), ms) for p, ms in of.items()])
        rows = materialize(rows)
        large = rows.groupBy("block", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD).select("block", "bits")
        masks = {r[0] for r in large.select("block").distinct().collect()}  # at most one per mask of this level
        splits = [(m, free) for m, free, _ in level if _signed(m) in masks and len(free) > 2 * parts]
        if not splits:
            done.append(rows)
            break
        cut = large.filter(F.col("block").isin([_signed(m) for m, _ in splits]))
        done.append(rows.join(cut, ["block", "bits"], "left_anti"))
        big = materialize(rows.join(cut, ["block", "bits"], "left_semi"))
        todo = splits
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the component is the smallest doc_id reachable."""
    prints = materialize(fingerprints(docs, words))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    edges = (
        _shards(nodes.select("fp"), radius)
        .repartition("block", "bits").sortWithinPartitions("block", "bits", "fp")
        .mapInArrow(_linked(radius), EDGES)
    )
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of one document of each component, the one with the smallest id."""
    return common.without(docs, near_duplicates(docs, words, radius).filter("doc_id <> component_id"))
