"""Scores of running contexts against a plain reading of the model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tests.llm.test_ppm import learn, tokens

from spreadlake.llm import byteppm, common, words


def symbols(text):
    return [s for t in tokens(text) for s in (*t.encode(), byteppm.STOP)]


def contexts(coded):
    past = (byteppm.STOP,) * byteppm.DEPTH
    for s in coded:
        yield past, s
        past = (*past[1:], s)


def brute(rows):
    learned = [x for i, x in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    seen = {}
    for text in learned:
        for past, s in contexts(symbols(text)):
            for order in range(byteppm.DEPTH + 1):
                seen.setdefault(past[byteppm.DEPTH - order:], Counter())[s] += 1

    def cost(past, s):
        total, out = 0.0, set()
        for order in range(byteppm.DEPTH, -1, -1):
            here = {k: n for k, n in seen.get(past[byteppm.DEPTH - order:], {}).items() if k not in out}
            if not here:
                continue
            if s in here:
                return total + math.log10((2 * here[s] - 1) / (2 * sum(here.values())))
            total += math.log10(len(here) / (2 * sum(here.values())))
            out |= set(here)
        return total - math.log10(256 - len(out))

    counts = Counter(t for x in learned for t in tokens(x))
    bottom = sum(counts.values()) + 0.5 * (len(counts) + 1)
    return {i: (len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), sum(counts.values()),
                sum(math.log10((counts[t] + 0.5) / bottom) for t in tokens(x)),
                sum(cost(past, s) for past, s in contexts(symbols(x)))) for i, x in rows}


def test_equals_a_plain_reading(docs, monkeypatch):
    monkeypatch.setattr(byteppm, "BLOCK_BYTES", 600)
    monkeypatch.setattr(byteppm, "ROWS", 50)
    rng = random.Random(5)
    known = ["the", "Thing", "of", "Zeta", "x1", "été", "là", "eau", "Ünder"]
    rows = [(i, " ".join(rng.choice(known) + rng.choice(["", "", "s", "ing"]) for _ in range(rng.randrange(30)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "unseen zq 漢字")]
    got = {r["doc_id"]: r for r in byteppm.scored(docs(rows), learn()).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, (n, told, train, base, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, told, train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-6)


def test_words_before_tell_what_comes_next(ready, docs, tmp_path):
    """Contexts once began anew at each word, so the order of words made no difference."""
    from spreadlake.llm import queries

    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, "salt pepper sugar") for i in learned] + [(held[0], "salt pepper sugar"), (held[1], "sugar salt pepper")]
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op4_ppm_score"](ready, str(tmp_path)).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_every_context_spends_all_of_its_probability():
    w = words.words_of(pa.array(["the thing of this", "le thé"]))
    each, n = byteppm.added(*(lambda k: (k, np.ones(len(k), np.int64)))(byteppm.coded(w)[0]))
    every = np.unique((each >> 8 << 8)[:, None] | np.arange(256)[None, :])
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, each)] = n
    cost = byteppm.costs(byteppm.levels(every, counts, byteppm.DEPTH + 1))
    assert np.allclose((10.0 ** cost).reshape(-1, 256).sum(axis=1), 1)


def test_odd_rows(docs, odd):
    got = byteppm.scored(docs(odd), learn()).collect()
    assert len(got) == len(odd) - 1 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert byteppm.scored(docs(odd).limit(0), learn()).collect() == []
    untrained = byteppm.scored(docs([(1, "ab")]), learn() & (learn() == False)).collect()[0]  # noqa: E712
    assert untrained["train_tokens"] == 0 and math.isclose(untrained["score"], -4 * math.log10(256), rel_tol=1e-6)


def test_scoring_gives_back_what_the_worker_held():
    text = pa.array(["a b"])
    keys = np.unique(byteppm.coded(words.words_of(text, lower=True))[0])
    common.held("a model of the stage before", object)
    docs = pa.table({"doc_id": pa.array([1], pa.int64()), "text": text, "block": pa.array([0], pa.int32())})
    told = [(0, "a", None, 1.0), (0, "b", None, 0.0), *((0, None, int(k), -0.5) for k in keys)]
    asked = pa.table(dict(zip(("block", "word", "key", "value"), map(list, zip(*told, strict=True)), strict=True)))
    got = byteppm._score(docs, asked).to_pylist()
    assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["score"]) for r in got] == [(1, 2, 1, -0.5 * len(keys))]
    assert not common._HELD
