"""Pieces against the tokenizer itself, and plans against bounds."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from spreadlake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def plain(encoder, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    return [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]


def test_texts_with_added_tokens(encoder):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|endof text|>", "plain words", "a <|endoftext|><|endoftext|>"]
    ids, count = encoder.encode(pa.array(texts, pa.string()))
    want = plain(encoder, texts)
    assert 50256 in want[0] and count.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(alphabet=" \t\n  ab1.'\u0085\x1c\x0bé€<|endoftext|>", max_size=8), st.just("<|endoftext|>")), max_size=5).map("".join), min_size=1, max_size=8))
def test_cut_texts_encode_like_whole_ones(encoder, texts):
    ids, count = encoder.encode(pa.array(texts, pa.string()))
    want = plain(encoder, texts)
    assert count.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_a_worker_forgets_and_goes_on(encoder, monkeypatch):
    monkeypatch.setattr(packing.Encoder, "KEPT", 5)
    own, rng = packing.Encoder(PATH), random.Random(1)
    for _ in range(5):
        texts = [" ".join(rng.choice(["alpha", "beta", "gamma,", "é", "it's"]) for _ in range(9)) for _ in range(3)]
        ids, _ = own.encode(pa.array(texts))
        assert ids.tolist() == [i for x in plain(encoder, texts) for i in x]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
def test_plans_place_every_piece_and_do_not_lose_to_best_fit(lengths):
    counts = np.bincount(lengths, minlength=21)
    made = packing.plan(counts, 20)
    used = np.zeros(21, dtype=int)
    for parts, often in made:
        assert sum(n * k for n, k in parts) <= 20
        for n, k in parts:
            used[n] += k * often
    assert used.tolist() == counts.tolist()
    assert sum(t for _, t in made) <= sum(t for _, t in packing.plan(counts, 20, search=False))


def test_completion_finds_an_exact_filling_best_fit_misses():
    counts = np.bincount([7, 5, 5, 4], minlength=11)
    assert packing._waste(packing._greedy(counts, 10), 10) > 0
    assert packing._waste(packing.complete(counts, 10), 10) == 0


def check(encoder, rows, got, size):
    wanted = sorted(
        (i, tuple([*ids, 2])) for (i, _), ids in zip(rows, plain(encoder, [t or "" for _, t in rows]), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, ids in wanted:
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        copies = sum(j == i for j, _ in wanted)
        pieces = pieces[::copies]
        at = 0
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == size or (k == 0 and 0 < r["length"] <= size))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for placed in by_sequence.values():
        at = 0
        for r in sorted(placed, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence)


def test_pieces_and_places(docs, encoder):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["tion", "the", "zebra"]) for _ in range(rng.randrange(1, 150)))) for i in range(120)]
    got = packing.pack(docs(rows), PATH, 64).collect()
    sequences = check(encoder, rows, got, 64)
    assert sequences <= 1.02 * -(-sum(r["length"] for r in got) // 64) + 1


def test_odd_rows(docs, odd, encoder):
    got = packing.pack(docs(odd), PATH).collect()
    check(encoder, [(i, t) for i, t in odd if i is not None], got, 1024)
    assert packing.pack(docs(odd).limit(0), PATH).collect() == []


@pytest.mark.parametrize(("size", "lengths", "sequences"), [
    (50, [2, 13, 21, 14] * 4, 4),
])
def test_plans_go_back_over_fillings_of_earlier_sequences(size, lengths, sequences):
    made = packing.plan(np.bincount(lengths, minlength=size + 1), size)
    assert sum(t for _, t in made) == sequences
    used = np.zeros(size + 1, dtype=int)
    for parts, often in made:
        assert sum(n * k for n, k in parts) <= size
        for n, k in parts:
            used[n] += k * often
    assert used.tolist() == np.bincount(lengths, minlength=size + 1).tolist()


def test_a_plan_search_that_ends_early_keeps_every_piece(monkeypatch):
    monkeypatch.setattr(packing, "PLAN_NODES", 10)
    counts = np.bincount([2, 13, 21, 14] * 4, minlength=51)
    made = packing.plan(counts, 50)
    assert sum(t for _, t in made) <= sum(t for _, t in packing.plan(counts, 50, search=False))
    assert sum(n * k * t for parts, t in made for n, k in parts) == 200


def test_the_tokenizer_gets_little_text_at_once():
    """What it tells of a token is far larger than the text, so a call is bounded."""
    encoder = packing.Encoder(PATH)
    real, sizes = encoder.tokenizer, []

    class Seen:
        def encode_batch_fast(self, texts, **options):
            sizes.append(sum(map(len, texts)))
            return real.encode_batch_fast(texts, **options)

    encoder.tokenizer = Seen()
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(2000)) for i in range(60)])
    ids, count = encoder.encode(texts)
    assert len(sizes) > 2 and max(sizes) <= 2 * (128 << 10)
    assert [ids[b - n:b].tolist() for b, n in zip(np.cumsum(count), count, strict=True)] == [
        real.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
