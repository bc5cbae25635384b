"""Leaks against all alignments."""

import itertools
import random
import time
import tracemalloc

import pyarrow as pa
import pytest

from spreadlake.llm import decontaminate as D

BENCH = "item_id long, text string"


def brute(rows, items):
    out = set()
    for d, t in rows:
        w = (t or "").split()
        for i, x in items:
            q = (x or "").split()
            need = min(D.WINDOW, len(q))
            if d is None or i is None or need < D.MIN_WORDS:
                continue
            least = need if len(q) < D.TOLERANT_WORDS else -(-need * 8 // 10)
            for shift in range(-(len(q) - need), len(w) - need + 1):
                a, b = max(0, shift), min(len(w), shift + len(q))
                agree = [w[k] == q[k - shift] for k in range(a, b)]
                if any(sum(agree[k:k + need]) >= least for k in range(len(agree) - need + 1)):
                    out.add((d, i))
                    break
    return out


def test_masks_hit_every_window_with_one_word_in_five_replaced():
    for n in range(D.TOLERANT_WORDS, D.WINDOW + 1):
        laid = [{p + s for p in m} for m in D.SEEDS for s in range(n - m[-1])]
        most = n - -(-n * 8 // 10)
        assert all(any(not h & set(gone) for h in laid) for gone in itertools.combinations(range(n), most))


def test_equals_all_alignments(ready, docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 100)
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 8, 12, 18, 25, 40])))) for i in range(20)]
    rows = []
    for d in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            q = rng.choice(items)[1].split()
            q = q[rng.randrange(2) * 3:]
            for _ in range(rng.randrange(7)):
                q[rng.randrange(len(q))] = rng.choice(vocabulary)
            at = rng.randrange(len(w) + 1)
            w[at:at] = q
        rows.append((d, " ".join(w)))
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs(rows), ready.createDataFrame(items, BENCH)).collect()}
    want = brute(rows, items)
    assert got == want and len(want) > 20


def test_small_runs_change_nothing(ready, docs, monkeypatch):
    monkeypatch.setattr(D, "HITS", 7)
    monkeypatch.setattr(D, "CELLS", 50)
    rng = random.Random(16)
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([5, 11, 12, 19, 30])))) for i in range(12)]
    rows = [(d, " ".join(rng.choice("abc" if d % 2 else "ab") for _ in range(rng.randrange(40)))) for d in range(60)]
    index = D.Index([i for i, _ in items], [t for _, t in items], D.SHARE, D.WINDOW)
    text = pa.array([t for _, t in rows])
    got = {(int(d), int(i)) for doc, item, *_ in index.leaks(text) for d, i in zip(doc, item)}
    want = brute(rows, items)
    assert got == want and 30 < len(want) < 600


@pytest.mark.parametrize("text", ["same " * 1_000_000, "one two " * 500_000])
def test_a_long_text_of_few_words(text):
    item = " ".join((text.split()[:2] * 25)[:50])
    index = D.Index([3, 4], [item, "other words " * 20], D.SHARE, D.WINDOW)
    begun = time.time()
    tracemalloc.start()
    best = {}
    for doc, it, start, n, agreed in index.leaks(pa.array([text])):
        for d, i, s, k in zip(doc.tolist(), it.tolist(), start.tolist(), agreed.tolist()):
            best[d, i] = max(best.get((d, i), (0, 0)), (k, -s))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert best == {(0, 0): (20, 0)}
    assert time.time() - begun < 60 and peak < 1 << 30


def test_case_and_punctuation_do_not_hide_a_leak(ready, docs):
    item = "One two three four five six seven eight nine ten eleven twelve"
    bench = ready.createDataFrame([(1, item)], BENCH)
    found = D.leaks(docs([(5, "x -- " + item.upper().replace(" ", ", ") + "!"), (6, "one two three")]), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["start"], r["words"], r["agreed"]) for r in found] == [(5, 1, 1, 12, 12)]
    assert sorted(r["doc_id"] for r in D.remove_leaking(docs([(5, item), (6, "one two three"), (7, None)]), bench).collect()) == [6, 7]


def test_odd_rows(ready, docs, odd):
    bench = ready.createDataFrame([(1, None), (None, "y " * 40), (2, ""), (3, "x " * 30), (3, "x " * 30), (4, "same row again and again")], BENCH)
    got = sorted((r["doc_id"], r["item_id"]) for r in D.leaks(docs(odd), bench).collect())
    assert got == [(7, 3), (11, 4)]
    assert D.leaks(docs(odd), bench.limit(0)).collect() == []
    assert D.leaks(docs(odd).limit(0), bench).collect() == []


def test_blocks_are_written_and_released_one_by_one(ready, docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 30)
    items = [(i, " ".join(f"b{i}x{k}" for k in range(20))) for i in range(8)]
    log = []
    context = ready.sparkContext
    make = context.broadcast

    def logged(value):
        log.append("sent")
        kept = make(value)
        destroy = kept.destroy
        kept.destroy = lambda: (log.append("released"), destroy())
        return kept

    monkeypatch.setattr(context, "broadcast", logged)
    out = D.leaks(docs([(i, t) for i, t in items] + [(99, "none of them")]), ready.createDataFrame(items, BENCH))
    assert log == ["sent", "released"] * 8
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == [(i, i) for i, _ in items]
