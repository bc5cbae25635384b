"""Scores against a plain reading of the model, and that they are probabilities."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spreadlake.llm import common, ppm


def learn():
    return F.pmod(common.crc_of_id(), F.lit(5)) != 1


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def spelled(word, seen):
    """Escapes and exclusions, one byte after the other; `seen` by context classes."""
    total, past = 0.0, [26] * ppm.ORDER
    for s in (*word.encode(), ppm.STOP):
        out = set()
        for order in range(ppm.ORDER, -1, -1):
            here = {k: n for k, n in seen.get(tuple(past[ppm.ORDER - order:]), {}).items() if k not in out}
            if not here:
                continue
            weight = sum(here.values()) + len(here)
            if s in here:
                total += math.log10(here[s] / weight)
                break
            total += math.log10(len(here) / weight)
            out |= set(here)
        else:
            total -= math.log10(256 - len(out))
        past = [*past[1:], int(ppm._CLASS[s])]
    return total


def brute(rows):
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    labels = Counter(r[2] for r in learned)
    parts = []
    for name, texts in labels.items():
        counts = Counter(t for i, x, lang in learned if lang == name for t in tokens(x))
        n = sum(counts.values())
        words = {w: c for w, c in counts.items() if w}
        once, twice = (sum(c == k for c in words.values()) for k in (1, 2))
        d = max(0.1, once / max(1, once + 2 * twice))
        seen = {}
        for w in words:
            past = [26] * ppm.ORDER
            for s in (*w.encode(), ppm.STOP):
                for order in range(ppm.ORDER + 1):
                    seen.setdefault(tuple(past[ppm.ORDER - order:]), Counter())[s] += 1
                past = [*past[1:], int(ppm._CLASS[s])]
        parts.append((texts / len(learned), counts, n, d, d * len(counts) / n, seen))
    every = sum((p[1] for p in parts), Counter())
    bottom = sum(every.values()) + 0.5 * (len(every) + 1)
    out = {}
    for i, text, _ in rows:
        ts = tokens(text)
        logs = [math.log10(w) + sum(math.log10(max(c[t] - d, 0) / n + e * 10 ** spelled(t, seen)) for t in ts) for w, c, n, d, e, seen in parts]
        top = max(logs)
        out[i] = (len(ts), sum(every[t] > 0 for t in ts), sum(every.values()),
                  sum(math.log10((every[t] + 0.5) / bottom) for t in ts), top + math.log10(sum(10 ** (x - top) for x in logs)))
    return out


def test_equals_a_plain_reading(docs, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 600)
    rng = random.Random(5)
    words = {"en": ["the", "thing", "of", "Zeta", "x1"], "fr": ["été", "le", "la", "eau"]}
    rows = []
    for i in range(40):
        lang = "en" if i % 3 else "fr"
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "", "s", "ing"]) for _ in range(rng.randrange(30))), lang))
    got = {r["doc_id"]: r for r in ppm.pretrained(docs(rows), learn()).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, (n, known, train, base, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-5)


def test_every_context_spends_all_of_its_probability():
    context, symbol, _ = ppm._spelled(pa.array(["the", "this", "été", "a1"]))
    keys, times = np.unique(context * ppm.SYMBOLS + symbol, return_counts=True)
    sums = (10.0 ** ppm.trie_costs(keys, times).astype(float)).reshape(-1, ppm.SYMBOLS).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-5)


def test_odd_rows(docs, odd):
    got = ppm.pretrained(docs(odd), learn()).collect()
    assert len(got) == len(odd) - 1 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert ppm.pretrained(docs(odd).limit(0), learn()).collect() == []
    untrained = ppm.pretrained(docs([(1, "ab")]), F.lit(False)).collect()[0]
    assert untrained["train_tokens"] == 0 and math.isclose(untrained["score"], -4 * math.log10(256), rel_tol=1e-6)


def test_adaptive_code_gets_shorter_with_repeats():
    one, two = ppm.adaptive_score("a strange sentence"), ppm.adaptive_score("a strange sentence a strange sentence")
    assert two < one and two > 1.6 * one and ppm.adaptive_score(None) < 0
