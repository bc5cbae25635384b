"""Removed lines against all pairs."""

import random
import re

from pyspark.sql import functions as F

from spreadlake.llm import common, linededup


def tokens(line, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", line)
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words=5, threshold=0.8):
    lines = sorted({(i, k, line) for i, t in rows if i is not None and t for k, line in enumerate(t.split("\n"))})
    sets = [(i, k, tokens(line, words)) for i, k, line in lines]
    out = {}
    for at, (i, k, x) in enumerate(sets):
        if x and any(y and len(x & y) >= threshold * len(x | y) - 1e-9 for _, _, y in sets[:at]):
            out.setdefault(i, []).append(k)
    return out


def run(df, **more):
    return {r["doc_id"]: r["removed"] for r in linededup.per_document(df, **more).collect()}


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of"] * 10
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(4)):
            line = list(rng.choice(bases))
            for _ in range(rng.randrange(3)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ", "  ", "\t"]).join(line) + rng.choice(["", " ", "\r"]))
        rows.append((i, "\n".join(lines)))
    return rows


def test_equals_all_pairs(docs):
    for seed, words in ((1, 5), (2, 1), (3, 2)):
        rows = made(seed)
        want = brute(rows, words)
        assert want and run(docs(rows), words=words) == want


def test_large_sides_are_shuffled(docs, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = made(4)
    assert run(docs(rows)) == brute(rows)


def test_lines_go_and_all_else_stays(docs):
    line = "a line of boilerplate that stands in more than one text"
    df = docs([(1, f"own words here\n{line}"), (2, f"{line}\n\nother words"), (3, None), (4, line)]).withColumn("n_chars", F.length("text").cast("long"))
    out = {r["doc_id"]: (r["text"], r["n_chars"], r["removed"]) for r in linededup.remove_lines(df).collect()}
    assert out == {1: (f"own words here\n{line}", 15 + len(line), "x"), 2: ("\nother words", 12, "x"), 3: (None, None, "x"), 4: ("", 0, "x")}


def test_odd_rows(docs, odd):
    assert run(docs(odd)) == brute(odd) == {5: [0]}
    assert run(docs(odd).limit(0)) == {}
    kept = linededup.remove_lines(docs(odd))
    assert kept.columns == docs(odd).columns and kept.count() == len(odd)
