"""Fingerprints and components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from spreadlake.llm import simhash
from spreadlake.llm.components import components


def plain(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(links, nodes):
    of = {x: x for x in nodes}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def close(prints, radius=3):
    items = sorted(prints.items())
    return [(i, j) for k, (i, a) in enumerate(items) for j, b in items[:k] if (a ^ b).bit_count() <= radius]


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_forest_connects_what_all_pairs_connect(n):
    rng = random.Random(n)
    centre = [rng.getrandbits(64) for _ in range(3)]
    prints = set()
    for _ in range(n):
        near = rng.choice(centre)
        for _ in range(rng.randrange(4)):
            near ^= 1 << rng.randrange(64)
        prints.add(near)
    prints = sorted(prints)
    pairs = simhash.forest(np.array(prints, dtype=np.uint64), 3)
    named = dict(enumerate(prints))
    assert len(pairs) < max(1, len(prints))
    assert all((named[a] ^ named[b]).bit_count() <= 3 for a, b in pairs)
    assert joined([tuple(map(int, p)) for p in pairs], named) == joined(close(named), named)


def test_equals_all_pairs(docs, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)  # so that shards are cut again
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(40, 90))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs(rows)).collect()}
    prints = {i: plain(t) for i, t in rows}
    roots = joined(close(prints), prints)
    assert got == {i: (prints[i], roots[i]) for i in prints}


def test_odd_rows(docs, odd):
    got = sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs(odd)).collect())
    assert [(i, f) for i, f, _ in got] == sorted((i, plain(t)) for i, t in odd if i is not None)
    named = dict((i, c) for i, _, c in got)
    assert named[1] == named[2] == named[3] == 1 and named[4] == named[5] == 4 and named[11] == 11
    kept = simhash.keep_one(docs(odd))
    assert kept.columns == docs(odd).columns and {2, 3, 5}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert simhash.near_duplicates(docs(odd).limit(0)).collect() == []


def test_components_of_chains_stars_and_loops(ready):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, 8), (8, 7)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    got = {r["node"]: r["root"] for r in components(ready.createDataFrame(edges, "a long, b long")).collect()}
    assert got == joined([e for e in edges if e[0] != e[1]], sorted(nodes))
    assert components(ready.createDataFrame([], "a long, b long")).collect() == []
