"""Top-k search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlake.llm import topk


def brute(rows, asked, k):
    out = []
    for q, x in asked:
        found = [(sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q]
        found.sort(key=lambda p: (-p[0], p[1]))
        out += [(q, r, i, s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def run(spark, rows, asked, k):
    schema = "id long, weights array<long>"
    got = topk.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), k)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("density", [1.0, 0.3])
def test_equals_brute_force(ready, monkeypatch, density):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 12) * (rng.random(12) < density)).tolist()) for i in range(600)]
    assert run(ready, rows, rows[::40], 10) == brute(rows, rows[::40], 10)


def test_ties_few_rows_short_vectors_and_huge_values(ready):
    same = [(i, [1, 2]) for i in range(8)]
    assert run(ready, same, [same[5]], 3) == [(5, 1, 0, 5), (5, 2, 1, 5), (5, 3, 2, 5)]
    rows = [(1, [1, 2, 3]), (2, [1]), (3, []), (4, [0, 0, 1 << 30])]
    assert run(ready, rows, rows, 9) == brute([(i, x + [0] * (3 - len(x))) for i, x in rows], [(i, x + [0] * (3 - len(x))) for i, x in rows], 9)
    assert run(ready, [], [], 3) == []


def test_unusable_vectors_take_no_part(ready):
    df = ready.createDataFrame(
        [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [0.515625, -0.01])],
        "vec_id long, embedding array<float>")
    kept = df.filter(topk.usable(F.col("embedding"))).select("vec_id", topk.integer_weights(F.col("embedding")).alias("w"))
    assert sorted(map(tuple, kept.collect())) == [(1, [64, 128]), (6, [33, -1])]
