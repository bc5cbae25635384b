"""Removed words against a brute-force reading of all windows."""

import random
import re

from spreadlake.llm import substring


def brute(rows, window):
    rows = [(i, t) for i, t in rows if i is not None]
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, w in split:
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s:s + window])] < (i, s) for p in range(s, s + window)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def run(df, window):
    return sorted(map(tuple, substring.remove_repeats(df, window).collect()))


def test_equals_brute_force(docs, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 2000)
    rng = random.Random(3)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(5, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((i * 7 % 61, " ".join(words)))
    for window in (6, 9, 20):
        assert run(docs(rows), window) == brute(rows, window)


def test_repeats_inside_one_document(docs):
    rows = [(1, "a " * 50), (2, "a b " * 30), (3, "a " * 19)]
    assert run(docs(rows), 20) == brute(rows, 20)


def test_odd_rows(docs, odd):
    assert run(docs(odd), 20) == brute(odd, 20)
    assert run(docs(odd).limit(0), 20) == []
