"""Roots and proofs against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spreadlake.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, tree string, low string, children string, row string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """(top, [(left, right) of each level] of every leaf)."""
    level, sides, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // 3 * 3
            sides[k].append(("".join(level[first:i]), "".join(level[i + 1:first + 3])))
            at[k] = i // 3
        level = [H("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], sides


def plain(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, out = [], []
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        tops.append(tree([leaf_of(r) for r in by[s]]))
    root, upper = tree([t for t, _ in tops])
    for s, (top, sides), above in zip(order, tops, upper):
        for r, own in zip(by[s], sides):
            path = own + above
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf_of((*r[:4], r[4].replace("\n", "") if hit and r[4] is not None else r[4]))
            for a, b in path:
                node = H(a + node + b)
            out.append((r[0], leaf_of(r), top, root, H("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


@pytest.fixture
def run(ready):
    def go(rows):
        docs = ready.createDataFrame([(*r[:2], *r[2:], "x", "x", "x", "x") for r in rows], COLUMNS).repartition(3)
        found = merkle.manifest(docs, found=merkle.leaf_without_line_feeds())
        ends = found.withColumn("end", merkle.folded(F.col("found"), F.col("sides")))
        return sorted(map(tuple, ends.select(
            "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("sides")), "end", F.col("end") == F.col("root")).collect()), key=repr)

    return go


def test_trees_of_many_heights(run):
    rng = random.Random(3)
    rows, n = [], 0
    for source, size in (("a", 1), ("é", 2), ("b", 3), (None, 4), ("", 9), ("B", 10), ("hot", 100), ("=", 28)):
        for _ in range(size):
            rows.append((n, source, rng.choice(["en", None]), rng.choice([5, None]), rng.choice(["one\ntwo", "one", None, "", "\n", "漢\n"])))
            n += 1
    got = run(rows)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


def test_ties_and_rows_without_an_id(run):
    rows = [(None, "s", "en", 1, "a\n"), (None, "s", "en", 1, "b"), (7, "s", "en", 1, "x"), (7, "s", "en", 1, "x"), (7, "s", "de", 1, "x\n"),
            (2, "s", None, None, None), (-4, None, "en", 2, "\n" * 50_000 + "y" * 50_000)]
    assert run(rows) == plain(rows)


def test_one_row_and_no_row(run):
    rows = [(6, "s", "en", 3, "a\nb")]
    got = run(rows)
    assert got == plain(rows) and got[0][2] == got[0][3] == got[0][1] and got[0][4] == H("")
    assert run([]) == []


def test_a_large_source_takes_no_python_worker_and_no_window_of_its_own(ready):
    docs = ready.createDataFrame([(i, "s", "en", 1, "x") for i in range(50)], "doc_id long, source string, lang string, n_chars long, text string")
    plan = merkle.manifest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan and "CartesianProduct" not in plan
