"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over SPAN consecutive words that ignores some positions. Words
at the kept positions are hashed at every place of every text and of every benchmark
item; a hash that both have is a hit, whatever stands at the ignored positions, so
that a copy with words replaced is still hit where a plain n-gram would not be: the
masks here hit every window of 12 to 20 words in which any fifth of them was replaced.
A hit fixes which word of the text lies against which word of the item. Around it the two are
compared word by word, so many at a time that a long text of few different words needs no
more memory than another: an item leaks when, in some window of `window` words (the whole
item where it has fewer), at least `share` of the words against each other agree.

The benchmark is hashed in blocks of bounded size. The hashes of one block are sent to
all tasks, which join them to the hashes of their texts; further blocks are further
passes over the texts. What a block finds is written, and its hashes are released,
before the next block is fetched.

Words are compared in lower case, without what is not a letter or digit at their ends.

Defined cases: null texts have no words; items of fewer than TOLERANT_WORDS words leak
when all of them stand in the text in a row; items of fewer than MIN_WORDS are never
found; rows without an id are left out;
repeated rows, and items with the same id, are reported once; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from spreadlake.llm import common, words
from spreadlake.session import new_shared_path

# Kept positions of each mask.
SEEDS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 6))
MIN_WORDS = 5
# Items of fewer words have to stand in a text as they are.
TOLERANT_WORDS = 12
WINDOW = 20
SHARE = 0.8
# Words of the benchmark in one block.
BLOCK_WORDS = 200_000
# Pairs of equal seeds, and words laid against each other, that are looked at at once.
HITS = 1 << 20
CELLS = 1 << 21

LEAKS = "doc_id long, item_id long, start long, words long, agreed long"


def compared(text: pa.Array) -> tuple[np.ndarray, words.Words]:
    """Hashes of compared words; each distinct raw word is folded once."""
    w = words.words_of(text)
    coded = w.flat.dictionary_encode()
    bare = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"^[^\pL\pN]+|[^\pL\pN]+$", "")
    known = words.word_hashes(bare)
    real = pc.not_equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy()
    keep = real[code]
    doc = w.doc[keep]
    return known[code[keep]], words.Words(w.flat, doc, np.bincount(doc, minlength=len(text)).astype(np.int64))


def seed_hashes(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the kept positions of the mask laid on each place."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for p in mask:
            out = out * words.power(1) + h[p:p + n]
    return words.mixed(out)


class Index:
    """Seed hashes of one block of items."""

    def __init__(self, items: list[int], texts: list[str | None], share: float, window: int):
        self.share, self.window = share, window
        self.hashes, w = compared(pa.array(texts, pa.string()))
        self.items, self.first, self.count = np.array(items, dtype=np.int64), w.first, w.count
        self.longest = int(self.count.max(initial=0))
        self.seeds, orders, base = [], [], 0
        for mask in SEEDS:
            found = seed_hashes(self.hashes, mask)
            item = w.doc[: len(found)]
            inside = item == w.doc[len(w.doc) - len(found):] if len(found) else np.empty(0, bool)
            at = np.flatnonzero(inside)
            order = at[np.argsort(found[at], kind="stable")]
            keys = found[order]
            # a bit for each hash's low bits rejects nearly all places of a text at once
            bits = np.zeros(1 << 22, bool)
            bits[keys & np.uint64((1 << 22) - 1)] = True
            self.seeds.append((mask, keys, base, bits))
            orders.append(order)
            base += len(order)
        # of every seed, masks end to end: its item, and its place there
        every = np.concatenate(orders)
        self.owner = w.doc[every]
        self.inside = every - self.first[self.owner]

    def hits(self, h: np.ndarray, w: words.Words) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, shift) of every pair of equal seeds, once each: word i of the
        item lies against word i + shift of the text. They come in runs of places, each of
        HITS pairs at most (or those of one place), so that a text of few different words
        is never held against an item all at once; a run may repeat some of the one before."""
        places, lows, counts = [], [], []
        for mask, keys, base, bits in self.seeds:
            found = seed_hashes(h, mask)
            if not len(found) or not len(keys):
                continue
            maybe = np.flatnonzero(bits[found & np.uint64(len(bits) - 1)])
            maybe = maybe[w.doc[maybe] == w.doc[maybe + mask[-1]]]
            low, high = np.searchsorted(keys, found[maybe], "left"), np.searchsorted(keys, found[maybe], "right")
            real = high > low
            places.append(maybe[real]), lows.append(low[real] + base), counts.append((high - low)[real])
        if not places:
            return
        place, low, n = (np.concatenate(x) for x in (places, lows, counts))
        order = np.argsort(place, kind="stable")
        place, low, n = place[order], low[order], n[order]
        doc, ends, at = w.doc[place], np.cumsum(n), 0
        here = place - w.first[doc]
        while at < len(place):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + HITS, side="right")))
            which, k = common.spans_of(n[at:stop])
            mine = low[at:stop][which] + k
            # one number for each of them: fits, as a slice of texts has one text or few words
            span = int(w.count[doc[at:stop]].max()) + self.longest + 1
            pair = (doc[at:stop][which] - doc[at]) * len(self.items) + self.owner[mine]
            coded = np.unique(pair * span + here[at:stop][which] - self.inside[mine] + self.longest)
            pair = coded // span
            yield pair // len(self.items) + doc[at], pair % len(self.items), coded % span - self.longest
            at = stop

    def leaks(self, text: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, start, words, agreed) of the best windows that leak: one at least of
        each text and item where one does, and some more of long texts."""
        h, w = compared(text)
        first = w.first
        for doc, item, shift in self.hits(h, w):
            need = np.minimum(self.window, self.count[item])
            a = np.maximum(0, shift)
            size = np.minimum(w.count[doc], shift + self.count[item]) - a
            least = np.where(self.count[item] < TOLERANT_WORDS, need, np.ceil(self.share * need - 1e-9))
            mine, theirs = first[doc] + a, self.first[item] + a - shift
            diagonals = np.flatnonzero(size >= need)
            ends, at = np.cumsum(size[diagonals]), 0
            while at < len(diagonals):
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + CELLS, side="right")))
                some, at = diagonals[at:stop], stop
                start, agreed = best_windows(h, self.hashes, mine[some], theirs[some], size[some], need[some])
                leak = agreed >= least[some]
                some, start, agreed = some[leak], start[leak], agreed[leak]
                if len(some):
                    start = a[some] + start
                    order = np.lexsort((start, -agreed, item[some], doc[some]))
                    d, i = doc[some][order], item[some][order]
                    top = np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1])]
                    yield d[top], i[top], start[order][top], need[some][order][top], agreed[order][top]


def best_windows(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each diagonal, `size` words of x from i on against those of y from j on: the start
    of the window of `need` words with the most that agree (the first such), and how many do."""
    group, place = common.spans_of(size)
    upto = np.r_[0, np.cumsum(x[i[group] + place] == y[j[group] + place])]
    windows = size - need + 1
    group, place = common.spans_of(windows)
    begin = (np.cumsum(size) - size)[group] + place
    # the most agreeing, then the smallest start, as one number
    ranked = ((upto[begin + need[group]] - upto[begin]) << 32) - place
    best = np.maximum.reduceat(ranked, np.cumsum(windows) - windows)
    agreed = (best + (1 << 32) - 1) >> 32
    return (agreed << 32) - best, agreed


def _leaks(index):
    schema = common.schema_of(LEAKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        items = index.value
        for batch in common.tables_of(batches):
            ids = batch.column("doc_id").to_numpy()
            for doc, item, start, n, agreed in items.leaks(batch.column("text")):
                yield common.rows(schema, ids[doc], items.items[item], start, n, agreed)

    return run


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of at most BLOCK_WORDS words (one item at least), each
    fetched by itself."""
    held, texts, size = [], [], 0
    for row in benchmark.toLocalIterator():
        n = len((row["text"] or "").split())
        if held and size + n > BLOCK_WORDS:
            yield held, texts
            held, texts, size = [], [], 0
        held.append(row["item_id"]), texts.append(row["text"])
        size += n
    if held:
        yield held, texts


def _write_leaks(docs: DataFrame, index: Index, path: str) -> None:
    """Append what the items of one block find to the table; no task and no plan needs
    the block after this."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    try:
        docs.mapInArrow(_leaks(sent), LEAKS).write.mode("append").parquet(path)
    finally:
        sent.destroy()


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, start, words, agreed): the best window of each text and item
    that leaks; `start` counts compared words of the text."""
    docs = common.documents(docs)
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    path, blocks = new_shared_path(spark, "table"), 0
    for held, texts in _blocks(items.filter(F.col("item_id").isNotNull())):
        _write_leaks(docs, Index(held, texts, share, window), path)
        blocks += 1
    if not blocks:
        return spark.createDataFrame([], LEAKS)
    found = spark.read.schema(LEAKS).parquet(path)
    best = F.max(F.struct("agreed", (-F.col("start")).alias("back"), "words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.back")).alias("start"), "best.words", "best.agreed")


def remove_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows no benchmark item leaks into."""
    return common.without(docs, leaks(docs, benchmark))
