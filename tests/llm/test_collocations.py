"""Collocations against counts in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spreadlake.llm import collocations, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, longest):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i:i + m])] += 1
    return f, n


def plain(rows, least, longest):
    f, n = counts(rows, longest)
    out = set()
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        if any(q != g and len(q) > len(g) and c >= least and 100 * c >= 80 * a and any(q[i:i + len(g)] == g for i in range(len(q)))
               for (other, q), c in f.items() if other == lang):
            continue
        cuts = [(2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.add((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    return out


@pytest.fixture(scope="module", autouse=True)
def small_ranges(ready):
    """Keep the ranges of this small input apart, or there would be one segment."""
    ready.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    ready.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def run(df, **how):
    return {tuple(r[c] for c in ("lang", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(df, **how).collect()}


def random_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "é", "É", "of", "new", "york", "city", "x", "a b", "漢字"]
    joins = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r", "\x0b", "? "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice(joins) for _ in range(rng.randrange(40)))
        text += " new york city hall" * rng.randrange(4) + " the the the the the" * rng.randrange(2)
        rows.append((i, text, rng.choice(["en", "en", "fr", None])))
    return rows


def test_all_figures_equal_plain_counts(docs):
    rows = random_rows(1, 60)
    assert run(docs(rows), least=4) == plain(rows, 4, 4)
    rows = random_rows(2, 25)
    assert run(docs(rows), least=2, longest=3) == plain(rows, 2, 3)


def test_extensions_stand_for_what_they_hold(docs):
    rows = [(1, "a b c d. " * 8 + "a b c. " * 2 + "b c. " * 3, "en")]
    got = {r[1]: r[2] for r in run(docs(rows), least=5)}
    # of 13 `b c` and 10 `a b c`, 8 go on: 80 % of the longer one, fewer of the shorter
    assert set(got) == {"a b c d", "b c"}
    assert run(docs(rows), least=5) == plain(rows, 5, 4)


def test_pieces_are_cut_at_marks_and_texts():
    found = collocations.Pieces(pa.array(["en", None, "en", "en"]), pa.array(["A b.c", None, "", "\tD  b\r\nÉ "]))
    spelled = [found.spelling[i].as_py() for i in found.word]
    assert spelled == ["a", "b", "c", "d", "b", "É"]
    assert found.joined.tolist() == [False, True, False, False, True, False]
    assert [found.langs[i].as_py() for i in found.lang] == ["en"] * 6


def test_the_filter_never_loses_a_phrase():
    rng = np.random.default_rng(4)
    hashes, marks = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    bits = np.zeros(collocations.FILTER_BITS // 8, np.uint8)
    for place in collocations._places(hashes[:2000], marks[:2000]):
        np.bitwise_or.at(bits, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
    held = collocations._held(bits, collocations._places(hashes, marks))
    assert held[:2000].all() and not held[2000:].any()
    assert words.sequence_hashes(hashes, 3)[7] == words.sequence_hashes(hashes[7:10], 3)[0]


def test_scores_are_exact_beyond_64_bits(ready):
    big = 4 * 10**18
    rows = ready.createDataFrame([(big, big, big + 1), (30, 31, 90)], "a long, l long, r long")
    got = [r[0] for r in rows.select(collocations._score(rows.a, rows.l, rows.r)).collect()]
    assert got == [2_000_000 * big // (2 * big + 1), 2_000_000 * 30 // 121]


def test_ranks_and_ties(docs):
    rows = [(i, "b a. c d. c d e. f g. ", "en") for i in range(30)] + [(99, "zz yy. " * 31, None)]
    got = [(r["lang"], r["rank"], r["phrase"]) for r in collocations.best(docs(rows)).orderBy("lang", "rank").collect()]
    # 60 `c d`, of which 30 go on; equal scores by count, then phrase
    assert got == [("en", 1, "c d"), ("en", 2, "b a"), ("en", 3, "f g"), ("en", 4, "c d e"), ("und", 1, "zz yy")]
    few = collocations.best(docs(rows), keep=1).collect()
    assert {(r["lang"], r["phrase"]) for r in few} == {("en", "c d"), ("und", "zz yy")}


def test_odd_rows(docs, odd):
    rows = [(*r, "en") for r in odd]
    assert run(docs(odd), least=2) == plain(rows, 2, 4)
    assert run(docs(odd).limit(0)) == set()
    assert run(docs([(1, "word " * 300_000, "en")])) == {("en", "word word word word", 299_997, 300_000, 299_998, 300_000, 2_000_000 * 299_997 // 599_998)}
