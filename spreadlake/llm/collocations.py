"""Phrase collocations from sorted count streams.

A phrase is two to LONGEST words that stand side by side within a piece of text; it is a
candidate when it occurs LEAST times or more in its language. All counts are exact and over
whole texts. They come in one pass over the texts for each length, words first: a phrase can
only be frequent if both phrases one word shorter are, so that from the second pass on only
windows made of frequent parts are counted. What is known to be frequent goes to the tasks as
a Bloom filter of a fixed size (FILTER_BITS); it lets some others through, which the count
then drops, and never loses one, so that its size bears on speed alone. A task counts the
windows of a slice of texts in numpy, and Spark adds the slices' counts up.

The frequent phrases are laid out as streams, shortest first. In prefix order (by first word,
then second, ...) a phrase follows the phrases it begins with; in suffix order (by last word,
then the one before, ...) it follows those it ends with. One scan of the streams in each
order, all lengths side by side, hands every phrase the counts of its beginnings and of its
ends: the left and the right counts of every cut. No table of phrases is looked up, and a
scan is cut into segments wherever that evens it out, be it amid a word. The same two counts
say which shorter phrases an extension stands for; a longer phrase that holds another holds
one that is a single word longer and at least as frequent, so single words are enough.

Defined cases: a null text is empty; a null language is `und`; texts without words count
nothing; rows without a doc_id and repeated rows are texts like any other; equal scores are
ordered by count, then by phrase in UTF-8 byte order; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.llm import common, words
from spreadlake.operators.ordered import LastKnown, top_n_per_group, with_ordered
from spreadlake.session import materialize

LEAST, LONGEST, KEEP = 30, 4, 2000
# An extension with this share of a phrase's count, in percent, stands for it.
STANDS_FOR = 80
SCALE = 2_000_000

# Bits of the filter sent to the tasks: 8 MiB, whatever the corpus.
FILTER_BITS, FILTER_PARTS = 1 << 26, 256
SLICE_BYTES = 2 << 20

COUNTS = "lang string, phrase string, n long"
INSIDE, SPACE, BREAK = 0, 1, 2


def _classes() -> np.ndarray:
    """What each byte does: stands in a word, ends a word, or ends a piece."""
    kind = np.zeros(256, np.uint8)
    kind[list(b" \t")] = SPACE
    kind[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
    return kind


CLASSES = _classes()


class Pieces:
    """The words of a batch of texts, end to end: `code` numbers them by language and
    spelling, `joined` tells whether a word stands in one piece with the word before."""

    def __init__(self, lang: pa.Array, text: pa.Array):
        text = pc.ascii_lower(pc.fill_null(text, "")).cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        first = ends[:-1] - ends[0]
        kind = CLASSES[data]
        inside = kind == INSIDE
        fresh = np.zeros(len(data) + 1, bool)  # where a text begins
        fresh[first] = True
        fresh[len(data)] = True
        # a word goes on where two bytes of one text both stand in a word
        on = inside[:-1] & inside[1:] & ~fresh[1:-1]
        edge = np.zeros(1, bool)
        at = np.flatnonzero(inside & ~np.concatenate([edge[:len(data)], on]))
        stop = np.flatnonzero(inside & ~np.concatenate([on, edge[:len(data)]])) + 1
        flat = pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(np.concatenate([[0], np.cumsum(stop - at)])), pa.py_buffer(data[inside]))
        spelled = flat.dictionary_encode()
        self.spelling = spelled.dictionary
        langs = pc.fill_null(lang, "und").dictionary_encode()
        self.langs = langs.dictionary
        begin = np.searchsorted(at, first)
        self.lang = np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(np.append(begin, len(at))))
        self.word = spelled.indices.to_numpy()
        breaks = np.cumsum(kind == BREAK, dtype=np.int32)[at]
        self.joined = np.zeros(len(at), bool)
        self.joined[1:] = breaks[1:] == breaks[:-1]
        self.joined[begin[begin < len(at)]] = False

    def hashes(self) -> np.ndarray:
        return word_hashes(self.spelling)[self.word]

    def marks(self) -> np.ndarray:
        """A hash of each word's language."""
        return lang_hashes(self.langs)[self.lang]


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, as a sum over its bytes. Words that share one only make
    the filter let through more than it could."""
    flat = flat.cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    size = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size)
    each = words.mixed((place.astype(np.uint64) << np.uint64(8)) + data + np.uint64(1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
    return total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]


def lang_hashes(langs: pa.Array) -> np.ndarray:
    return words.mixed(word_hashes(langs))


def _places(hashes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for each phrase."""
    h = words.mixed(hashes + marks)
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _held(bits: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    one, two = (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1 for p in places)
    return (one & two).astype(bool)


def _windows(found: Pieces, length: int, bits: np.ndarray | None) -> np.ndarray:
    """Where the windows of `length` words begin that may be frequent."""
    n = len(found.word) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    whole = np.ones(n, bool)
    for k in range(1, length):
        whole &= found.joined[k:k + n]
    if bits is not None:
        part = words.sequence_hashes(found.hashes(), length - 1)
        known = _held(bits, _places(part, found.marks()[:len(part)]))
        whole &= known[:n] & known[1:n + 1]
    return np.flatnonzero(whole)


def _slice_counts(found: Pieces, length: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(start of one occurrence, count) of each distinct window of a slice."""
    starts = _windows(found, length, bits)
    size = np.int64(len(found.spelling))
    code = found.lang[starts] * size + found.word[starts]
    for k in range(1, length):
        if k > 1:  # numbered again, so that one more word still fits
            code = np.unique(code, return_inverse=True)[1]
        code = code * size + found.word[starts + k]
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    return starts[first], count


def _counter(length: int, bits):
    schema = common.schema_of(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = None if bits is None else bits.value
        for batch in common.tables_of(batches, limit=SLICE_BYTES):
            found = Pieces(batch.column("lang"), batch.column("text"))
            starts, count = _slice_counts(found, length, filter_)
            text = [found.spelling.take(pa.array(found.word[starts + k])).cast(pa.string()) for k in range(length)]
            phrase = text[0] if length == 1 else pc.binary_join_element_wise(*text, " ")
            lang = found.langs.take(pa.array(found.lang[starts]))
            for at in range(0, len(starts), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield common.rows(schema, lang[part], phrase[part], count[part])
            if length == 1 and len(found.word):
                # all words of each language, under no phrase
                total = np.bincount(found.lang, minlength=len(found.langs))
                yield common.rows(schema, found.langs, pa.nulls(len(total), pa.string()), total)

    return run


def _marker():
    """For batches of phrases, the words of 64 filter bits they set."""
    schema = common.schema_of("word long, bits long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = pc.split_pattern(batch.column("phrase"), " ")
            length = pc.list_value_length(lists)[0].as_py()
            hashes = words.sequence_hashes(word_hashes(lists.flatten()), length)
            marks = lang_hashes(batch.column("lang"))
            for place in _places(hashes[::length], marks):
                yield common.rows(schema, place >> 6, (np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64))

    return run


def _dense(key, rows):
    """One part of the filter, all its bits."""
    size = FILTER_BITS // 64 // FILTER_PARTS
    out = np.zeros(size, np.uint64)
    out[rows.column("word").to_numpy() % size] = rows.column("bits").to_numpy().view(np.uint64)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})


def _filter(frequent: DataFrame):
    """The Bloom filter of phrases of one length, as a broadcast of FILTER_BITS bits."""
    size = FILTER_BITS // 64 // FILTER_PARTS
    set_ = frequent.select("lang", "phrase").mapInArrow(_marker(), "word long, bits long")
    # one row for each word of 64 bits at most, and as many of them in a part
    parts = (
        set_.groupBy("word").agg(F.bit_or("bits").alias("bits"))
        .withColumn("part", F.floor(F.col("word") / F.lit(size)))
        .groupBy("part").applyInArrow(_dense, "part long, data binary")
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.collect():
        at = row["part"] * size * 8
        bits[at:at + size * 8] = np.frombuffer(row["data"], np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(bits)


def streams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases (lang, phrase, n) of each length from one word on, and all words of
    each language (lang, n)."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    out, bits, total = [], None, None
    for length in range(1, longest + 1):
        counted = texts.mapInArrow(_counter(length, bits), COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        kept = materialize(counted.filter((F.col("n") >= least) | F.col("phrase").isNull()))
        if length == 1:
            total, kept = kept.filter("phrase IS NULL").drop("phrase"), kept.filter("phrase IS NOT NULL")
        out.append(kept)
        if length < longest:
            bits = _filter(kept)
    return out, total


def _exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def _scan(lines: DataFrame, word: Column, longest: int, name: str) -> DataFrame:
    """Add name1, name2, ...: counts of the phrases of one word, two words, ... that each
    phrase begins with in the order of `word`, a phrase's words from one end."""
    order = [F.get(word, F.lit(k)) for k in range(longest)]
    size = F.size("words")
    # nulls come first, so that a phrase follows what it begins with
    placed = lines.withColumns({f"_at{k}": c for k, c in enumerate(order)})
    seen = with_ordered(
        placed, ["lang"], [F.col(f"_at{k}") for k in range(longest)],
        **{f"{name}{k}": LastKnown(F.when(size == k, F.col("a"))) for k in range(1, longest)})
    return seen.drop(*[f"_at{k}" for k in range(longest)])


def _extended(scanned: DataFrame, longest: int) -> DataFrame:
    """(lang, words) of phrases that an extension by one word stands for."""
    size = F.size("words")

    def side(counts: str, rest: Column) -> DataFrame:
        parent = F.coalesce(*[F.when(size == k + 1, F.col(f"{counts}{k}")) for k in range(2, longest)])
        stands = _exact(F.col("a")) * 100 >= _exact(parent) * STANDS_FOR
        return scanned.filter((size > 2) & stands).select("lang", rest.alias("words"))

    return side("left", F.slice("words", F.lit(1), size - 1)).unionByName(side("right", F.slice("words", F.lit(2), size - 1))).distinct()


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that no extension stands for."""
    counted, total = streams(docs, least, longest)
    lines = reduce(DataFrame.unionByName, counted).select("lang", F.split("phrase", " ").alias("words"), F.col("n").alias("a"))
    by_prefix = materialize(_scan(lines, F.col("words"), longest, "left"))
    scanned = materialize(_scan(by_prefix, F.reverse("words"), longest, "right").filter(F.size("words") > 1))
    size = F.size("words")
    cuts = []
    for m in range(2, longest + 1):
        # k words before the cut; the least score comes first, then the earliest cut
        each = [(F.lit(k), F.col(f"left{k}"), F.col(f"right{m - k}")) for k in range(1, m)]
        cuts.append(F.when(size == m, F.array_min(F.array(*[
            F.struct(_score(F.col("a"), l, r).alias("score"), k.alias("k"), l.alias("l"), r.alias("r")) for k, l, r in each]))))
    best = scanned.select("lang", "words", "a", F.coalesce(*cuts).alias("cut"))
    left = best.hint("merge").join(_extended(scanned, longest), ["lang", "words"], "left_anti")
    return left.join(common.checked(total), "lang").select(
        "lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(SCALE * a / (l + r)), exact beyond 64 bits."""
    return F.call_function("div", _exact(a) * F.lit(SCALE).cast("decimal(7,0)"), _exact(l) + _exact(r)).cast("bigint")


def best(docs: DataFrame, keep: int = KEEP) -> DataFrame:
    """The first `keep` collocations of each language, ranked."""
    found = materialize(collocations(docs))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    return top_n_per_group(found, ["lang"], order, keep, rank="rank")
