"""Phrases against greedy parsing, and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spreadlake.llm import common, langid


def phrases(text, sample):
    """Greedy longest matches; a symbol the sample does not hold is one phrase."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        count, at = count + 1, max(at + 1, end - 1)
    return count


def test_phrases_equal_greedy_longest_matches():
    rng = random.Random(7)
    samples = tuple((name, "".join(rng.choice(letters) for _ in range(400)).encode()) for name, letters in (("a", "abcd "), ("b", "abxyz ")))
    texts = ["".join(rng.choice("abcdxyzq ") for _ in range(rng.randrange(1, 700))) for _ in range(40)] + [""]
    got = langid.Parser(samples).entropies(pa.array(texts))
    for k, (_, sample) in enumerate(samples):
        folded = langid.folded(sample).tobytes()
        for t, bits in zip(texts, got[k]):
            raw = langid.folded(t.encode()).tobytes()
            want = sum(phrases(raw[i:i + langid.PIECE], folded) for i in range(0, len(raw), langid.PIECE))
            assert round(bits * max(1, len(raw)) / np.log2(len(folded) + 2)) == want


def test_the_automaton_reads_every_substring_and_no_other():
    text = b"abcbcbaabca"
    moves = langid.suffix_automaton(text)

    def reads(word):
        state = 0
        for c in word:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(map(reads, subs))
    assert not any(reads(w) for w in (b"aaa", b"bb", b"acb", b"x", b"cc"))


def learn():
    return F.pmod(common.crc_of_id(), F.lit(3)) != 1


def test_held_out_accuracy_and_determinism(docs):
    rng = random.Random(8)
    syllables = {"en": ["th", "ing", "er", "and", "st"], "es": ["cion", "os", "ar", "que", "ll"], "de": ["sch", "ein", "ung", "ü", "ver"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(40))
        rows.append((i, text, lang if i % 10 else None))
    truth = {i: next(k for k, s in syllables.items() if t.split()[0].startswith(tuple(s))) for i, t, _ in rows}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs(rows), learn()).collect()}
    assert len(got) == 300 and sum(got[i][0] == truth[i] for i in truth) >= 295
    assert all(0 <= s <= 1 for _, s in got.values())
    assert got == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs(rows[::-1]), learn()).collect()}


def test_odd_rows(docs, odd):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs(odd), learn()).collect()]
    assert len(got) == len(odd) - 1
    assert {i for i, lang, _ in got if lang == "und"} == {1, 2, 3, 10}
    assert all(s == 0 for _, lang, s in got if lang == "und")
    none = langid.predict(docs([(1, "words", None)]), learn()).collect()
    assert [(r["lang_pred"], r["score"]) for r in none] == [("und", 0.0)]
    kept = langid.reject_unknown(docs(odd), learn())
    assert kept.columns == docs(odd).columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 8, 9, 11}
    assert langid.predict(docs(odd).limit(0), learn()).collect() == []
