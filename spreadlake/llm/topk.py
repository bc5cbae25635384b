"""Exact top-k inner products by MaxScore.

A query's terms are the dimensions with a non-zero weight, a posting list the vectors
with a non-zero value there. A term can add at most its bound (its weight times the
largest or smallest value of the list) to a score. Terms are sorted by bound; those
whose bounds together stay under the score to beat are non-essential: a vector found
in their lists only cannot get in. The lists of the essential terms are traversed;
the vectors they lead to are then probed in the others, the largest bound first, as
long as what they have plus what is left can still beat the k-th score. Each shard of
vectors keeps its k best for each query, and the shards are merged by rank.

Vectors are dealt to shards, queries to blocks, both of bounded size, and each pair of
them is one task; no task or driver holds more.

Defined cases: vectors that are null or hold a null or non-finite component, and rows
without an id, take no part; a missing dimension (vectors of different length) counts
as zero; rows that share an id are each candidates, for queries of other ids, and each
is a query; fewer than k candidates are all returned; ties go to the smaller id; an
empty table gives no rows; other columns are ignored. Scores are 64-bit integers and
wrap beyond them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from spreadlake.llm import common

SHARD_ROWS = 4096
QUERY_ROWS = 2048
# Vectors scored in full first, so that there is a score to beat.
SEED_ROWS = 128

FOUND = "query long, query_id long, vec_id long, score long"


def _matrix(weights: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of integer weights, filled up with zeros to one width."""
    lists = pa.concat_arrays([c.cast(pa.list_(pa.int64())) for c in weights.chunks])
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), dtype=np.int64)
    row, place = common.spans_of(size)
    out[row, place] = lists.flatten().to_numpy()
    return out


class Shard:
    """Posting lists of some vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, largest_weight: int):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        # products are added as floats where every partial sum is exact
        reach = float(np.abs(values).max(initial=0)) * largest_weight * max(1, values.shape[1])
        self.kind = np.float64 if reach < 2.0**52 else np.int64
        self.lists = np.asfortranarray(values[order].astype(self.kind))
        self.high, self.low = self.lists.max(axis=0, initial=0), self.lists.min(axis=0, initial=0)

    def search(self, query_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best vectors with another id."""
        terms = np.flatnonzero(weights[: self.lists.shape[1]])
        weight = weights[terms].astype(self.kind)
        bound = np.maximum(weight * self.high[terms], weight * self.low[terms])
        by_bound = np.argsort(bound, kind="stable")
        terms, weight, bound = terms[by_bound], weight[by_bound], bound[by_bound]
        upto = np.cumsum(bound)
        others = self.ids != query_id
        start = np.flatnonzero(others)[:SEED_ROWS]
        scores = self.lists[np.ix_(start, terms)] @ weight
        best, best_scores = _best(start, scores, k)
        rest = np.flatnonzero(others)[SEED_ROWS:]
        if len(best) == k and len(rest):
            beat = best_scores[-1]
            plain = int(np.searchsorted(upto, beat, side="left"))  # terms that together stay under it
            essential = slice(plain, None)
            block = self.lists[rest[0]:]
            have = block[:, terms[essential]] @ weight[essential]
            listed = (block[:, terms[essential]] != 0).any(axis=1) if len(terms) - plain < 8 else np.ones(len(have), bool)
            left = upto[plain - 1] if plain else 0
            # a tie at the k-th score is lost to the smaller ids already there
            rows = np.flatnonzero(listed & others[rest[0]:] & (have + left > beat))
            have = have[rows]
            for t in range(plain - 1, -1, -1):
                have = have + block[rows, terms[t]] * weight[t]
                left = upto[t - 1] if t else 0
                alive = have + left > beat
                if not alive.all():
                    rows, have = rows[alive], have[alive]
            best, best_scores = _best(np.r_[best, rows + rest[0]], np.r_[best_scores, have], k)
        elif len(rest):
            scores = self.lists[np.ix_(rest, terms)] @ weight
            best, best_scores = _best(np.r_[best, rest], np.r_[best_scores, scores], k)
        return self.ids[best], best_scores.astype(np.int64)


def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores; rows are in the order of ids, which settles ties."""
    first = np.lexsort((rows, -scores))[:k]
    return rows[first], scores[first]


def _search(k: int):
    schema = common.schema_of(FOUND)

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        values, asked = _matrix(vectors.column("weights")), _matrix(queries.column("weights"))
        shard = Shard(vectors.column("id").to_numpy(), values, int(np.abs(asked).max(initial=0)))
        query, query_id = queries.column("query").to_numpy(), queries.column("id").to_numpy()
        out = [shard.search(i, w, k) for i, w in zip(query_id, asked, strict=True)]
        size = [len(ids) for ids, _ in out]
        return pa.Table.from_batches([common.rows(
            schema, np.repeat(query, size), np.repeat(query_id, size),
            np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out]))])

    return run


def integer_weights(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    """True where a vector is there and all of it is a finite number."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k rows of `vectors`
    with another id that have the highest inner product; both are (id, weights)."""
    rows, asked = vectors.count(), queries.count()
    shards, blocks = max(1, math.ceil(rows / SHARD_ROWS)), max(1, math.ceil(asked / QUERY_ROWS))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # the shard goes by the whole row, so that a repeated id does not fill one
    held = vectors.select("id", "weights", F.pmod(F.xxhash64("id", "weights"), F.lit(shards)).cast("int").alias("shard"),
                          every(blocks).alias("block"))
    numbered = queries.select("id", "weights", F.monotonically_increasing_id().alias("query"))
    sent = numbered.select("id", "weights", "query", every(shards).alias("shard"),
                           F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))
    found = held.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(_search(k), FOUND)
    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
