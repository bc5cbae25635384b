"""Prediction by partial matching over running text: a trie of byte contexts scores texts.

A text is its words (`[^\\x20\\x09-\\x0D]+`, A-Z in lower case), each followed by a
terminator, then one terminator more for its end; DEPTH terminators stand before it.
Every byte and terminator is a symbol, coded in the DEPTH symbols before it, whichever
words they are of: contexts run on from word to word, so the words before tell what
comes next. A symbol is coded in the longest context that it has followed in the training
texts. Contexts in which it was never seen are escaped from, the symbols seen in a
context escaped from are excluded below it, and contexts never met are passed over.
Where `n` of the `t` occurrences not excluded are the symbol's and `d` symbols make
them up, it has (2n - 1) / 2t and the escape d / 2t (method D). Below the empty context
all symbols left are equally likely. All counts come from every training text.

A symbol seen in a context was seen in all shorter ones, so what a context excludes from
the next shorter one is what it has seen itself: its count there and the number of its
symbols. The cost of a symbol follows from a few sums of each of its contexts, and
no sets are held.

The trie grows with the corpus and is never in one place. Texts are dealt to blocks of
bounded bytes; a block asks once for each symbol in a context of DEPTH and adds how often
its training texts hold it. What is asked is dealt by the last NEAR + 1 symbols of the
context, which gives a task whole branches of the trie: it adds them up, and answers every
block. Contexts of up to NEAR symbols are few (as many as there are different runs of
NEAR + 1 bytes) and sent to all tasks.

Defined cases: null texts are empty; an empty text is one end; rows without a doc_id
are left out; repeated rows each count and are each returned; with no training text
every symbol is equally likely; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.llm import common, words
from spreadlake.session import materialize

DEPTH = 5  # symbols of a context; it and the symbol coded are one long, with bits to spare
SPARE = 64 - 8 * (DEPTH + 1)
NEAR = 3
SYMBOLS = 256
STOP = 32  # ends a word, and a text
BLOCK_BYTES = 20 << 20
# Text coded at once; a symbol takes some thirty bytes for a while.
SLICE_BYTES = 2 << 20
# Rows priced or sent at once; a branch is never cut.
ROWS = 1 << 18

ASKED = "block int, word string, key long, n long"
PRICED = "block int, key long, value double"
SCORED = "doc_id long, n_tokens long, n_known long, logs double, score double"


def _bytes(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, end to end, and the size of each."""
    if not len(flat):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    _, ends, data = flat.buffers()
    ends = np.frombuffer(ends, np.int32)[flat.offset:flat.offset + len(flat) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]], np.diff(ends)


def coded(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every symbol, the last one first: the context, its newest symbol in
    the highest byte, and the symbol itself in the lowest."""
    data, size = _bytes(w.flat)
    length = np.bincount(w.doc, weights=size + 1, minlength=len(w.count)).astype(np.int64) + 1
    total = int(length.sum()) + DEPTH * len(length)
    symbols = np.full(total + 8, STOP, dtype=np.uint8)  # from the end of the last text on
    # a word's bytes come after DEPTH symbols for each text, and one for each word and text before it
    shift = np.arange(len(size)) + (DEPTH + 1) * w.doc + DEPTH
    symbols[total - 1 - np.arange(len(data)) - np.repeat(shift, size)] = data
    # the eight symbols before each one, as one number
    before = np.ndarray((total,), ">u8", symbols, 1, (1,)).astype(np.uint64)
    before >>= np.uint64(64 - 8 * DEPTH)
    before <<= np.uint64(8)
    before |= symbols[:total]
    last = np.cumsum(length[::-1] + DEPTH)
    real = np.ones(total, bool)
    for k in range(1, DEPTH + 1):
        real[last - k] = False
    text = np.repeat(np.arange(len(length), dtype=np.int32)[::-1], length[::-1])
    return before[real].view(np.int64), text


def added(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of their counts."""
    if not len(rows):
        return rows, n
    order = np.argsort(rows)
    rows = rows[order]
    first = _starts(rows)
    return rows[first], np.add.reduceat(n[order], first)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]])


def _counted(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many of each are learned from."""
    each = keys << 1
    each |= learned
    each.sort()
    first = _starts(each)
    each, times = each[first], np.diff(first, append=len(each))
    first = _starts(each >> 1)
    return each[first] >> 1, np.add.reduceat(np.where(each & 1, times, 0), first)


def _merged(seen: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(seen).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's words and keys with their counts in its training texts; rows come block
    by block."""
    schema = common.schema_of(ASKED)
    block, seen, keys, n = None, [], np.empty(0, np.int64), np.empty(0, np.int64)

    def rows():
        for part in _merged(seen).to_batches(max_chunksize=ROWS):
            some = part.num_rows
            yield common.rows(schema, np.full(some, block), part.column("word"), pa.nulls(some, pa.int64()), part.column("n"))
        for at in range(0, len(keys), ROWS):
            some = len(keys[at:at + ROWS])
            yield common.rows(schema, np.full(some, block), pa.nulls(some, pa.string()), keys[at:at + ROWS], n[at:at + ROWS])

    for batch in common.tables_of(batches, limit=SLICE_BYTES):
        of = batch.column("block").to_numpy()
        cut = np.flatnonzero(of[1:] != of[:-1]) + 1
        for start, stop in zip(np.r_[0, cut], np.r_[cut, len(of)], strict=True):
            texts = batch.slice(start, stop - start)
            if of[start] != block:
                if seen:
                    yield from rows()
                block, seen, keys, n = of[start], [], keys[:0], n[:0]
            learned = texts.column("learned").to_numpy(zero_copy_only=False).astype(np.int64)
            w = words.words_of(texts.column("text"), lower=True)
            kinds = w.flat.dictionary_encode()
            times = np.bincount(kinds.indices.to_numpy(), weights=learned[w.doc], minlength=len(kinds.dictionary))
            mine = pa.table({"word": kinds.dictionary, "n": pa.array(times.astype(np.int64))})
            seen.append(mine)
            if sum(t.num_rows for t in seen[1:]) > ROWS:
                seen = [_merged(seen)]
            each, text = coded(w)
            each, times = _counted(each, learned[text])
            keys, n = (each, times) if not len(keys) else added(np.r_[keys, each], np.r_[n, times])
    if seen:
        yield from rows()


@dataclass(frozen=True)
class Level:
    """The contexts of one length. A row is a context and a symbol, its lowest byte."""

    rows: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray  # symbols seen
    below: np.ndarray  # counts of these symbols in the next shorter context


def _shorter(rows: np.ndarray) -> np.ndarray:
    """The same symbols in contexts without their oldest one."""
    return rows >> 16 << 8 | rows & 255


def levels(rows: np.ndarray, n: np.ndarray, orders: int, known: tuple[Level, ...] = ()) -> tuple[Level, ...]:
    """Levels from the empty context to that of `rows`, which are distinct and in order;
    the last `orders` of them are made of `rows`, those before are `known`."""
    tables = [(rows, n)]
    while len(tables) < orders:
        rows, n = added(_shorter(rows), n)
        tables.append((rows, n))
    out = list(known)
    for rows, n in reversed(tables):
        context = rows >> 8
        first = _starts(context)
        seen = n > 0
        shared = np.where(seen, out[-1].n[np.searchsorted(out[-1].rows, _shorter(rows))], 0) if out else np.zeros(len(rows), np.int64)
        out.append(Level(rows, n, context[first], *[np.add.reduceat(x, first) for x in (n, seen.astype(np.int64), shared)]))
    return tuple(out)


def costs(trie: tuple[Level, ...]) -> np.ndarray:
    """log10 probability of each row of the deepest level."""
    keys = trie[-1].rows
    cost, escape, open_ = np.zeros(len(keys)), np.zeros(len(keys)), np.ones(len(keys), bool)
    taken, kinds, rows = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), keys
    for level in reversed(trie):
        at = np.searchsorted(level.contexts, rows >> 8)
        n = level.n[np.searchsorted(level.rows, rows)]
        left, fresh = 2.0 * (level.total[at] - taken), level.kinds[at] - kinds
        here = open_ & (n > 0)
        cost[here] = escape[here] + np.log10((2 * n[here] - 1) / left[here])
        open_ &= ~here
        goes = fresh > 0
        escape[goes] += np.log10(fresh[goes] / left[goes])
        taken, kinds, rows = level.below[at], level.kinds[at], _shorter(rows)
    cost[open_] = escape[open_] - np.log10(SYMBOLS - kinds[open_])
    return cost


def _priced(name: str, near):
    """Rows sorted by branch; whole branches are priced at a time."""
    schema = common.schema_of(PRICED)

    def answers(some: pa.Table) -> Iterator[pa.RecordBatch]:
        known = common.held(("near", name), lambda: levels(*near.value, NEAR + 1))
        keys = some.column("key").to_numpy()
        order = np.argsort(keys)
        keys, block = keys[order], some.column("block").to_numpy()[order]
        first = _starts(keys)
        n = np.add.reduceat(some.column("n").to_numpy()[order], first)
        # a symbol's rounding is far below what its count can tell, and half as long to send
        cost = np.repeat(costs(levels(keys[first], n, DEPTH - NEAR, known)).astype(np.float32).astype(np.float64),
                         np.diff(first, append=len(keys)))
        for at in range(0, len(keys), ROWS):
            yield common.rows(schema, block[at:at + ROWS], keys[at:at + ROWS], cost[at:at + ROWS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            branch = batch.column("branch").to_numpy()
            if sum(b.num_rows for b in held) >= ROWS and branch[-1] != last:
                cut = int(np.searchsorted(branch, last, side="right"))
                yield from answers(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, batch = [], batch.slice(cut)
            held.append(batch)
            last = branch[-1]
        if held:
            yield from answers(pa.Table.from_batches(held))

    return run


def _score(docs: pa.Table, asked: pa.Table) -> pa.Table:
    common.give_back()
    schema = common.schema_of(SCORED)
    told = pc.is_valid(asked.column("word"))
    names, counts = (asked.column(c).filter(told) for c in ("word", "value"))
    names, counts = pa.concat_arrays([pa.array([], pa.string()), *names.chunks]), counts.to_numpy()
    keys, cost = (asked.column(c).filter(pc.invert(told)).to_numpy() for c in ("key", "value"))
    order = np.argsort(keys)
    keys, cost = keys[order], cost[order].astype(np.float32)  # they were rounded to this
    del told, order
    out = []
    for batch in common.tables_of(docs.to_batches(), limit=SLICE_BYTES):
        rows = batch.num_rows
        w = words.words_of(batch.column("text"), lower=True)
        kinds = w.flat.dictionary_encode()
        c = counts[pc.index_in(kinds.dictionary, value_set=names).to_numpy(zero_copy_only=False)] if len(kinds) else np.empty(0)
        code = kinds.indices.to_numpy()
        known = np.bincount(w.doc, weights=(c > 0)[code], minlength=rows).astype(np.int64)
        logs = np.bincount(w.doc, weights=np.log10(c + 0.5)[code], minlength=rows)
        each, text = coded(w)
        score = np.zeros(rows)
        # a key and the text's number are sorted as one value, for so many texts at a time
        for at in range(0, rows, 1 << SPARE):
            some = (text >= at) & (text < at + (1 << SPARE)) if rows > 1 << SPARE else slice(None)
            both = each[some].view(np.uint64) << np.uint64(SPARE) | (text[some] - at).astype(np.uint64)
            both.sort()
            of = (both & np.uint64((1 << SPARE) - 1)).astype(np.int64)
            both >>= np.uint64(SPARE)
            here = np.bincount(of, weights=cost[np.searchsorted(keys, both.view(np.int64))])
            score[at:at + len(here)] = here
        out.append(common.rows(schema, batch.column("doc_id"), w.count, known, logs, score))
    pa.default_memory_pool().release_unused()
    return pa.Table.from_batches(out, schema=schema)


def scored(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document;
    `learn` tells, of `doc_id` alone, which documents are learned from. The base is the
    unigram score with half a count added."""
    docs = common.documents(docs)
    spark = docs.sparkSession
    size, ends = docs.agg(F.sum(F.octet_length("text")), F.count_if(learn)).first()
    blocks = max(1, math.ceil((size or 0) / BLOCK_BYTES))
    dealt = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learned"),
                        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    asked = materialize(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_asked, ASKED))
    told, keys = asked.filter("key IS NULL").select("block", "word", "n"), asked.filter("key IS NOT NULL").select("block", "key", "n")
    counts = materialize(told.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"))
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    near = F.shiftleft(F.shiftright("key", 8 * (DEPTH + 1 - NEAR)), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(SYMBOLS - 1)))
    few = keys.groupBy(near.alias("row")).agg(F.sum("n").alias("n")).orderBy("row").toArrow()
    model = spark.sparkContext.broadcast(tuple(few.column(c).to_numpy() for c in ("row", "n")))
    branch = F.shiftright("key", 8 * (DEPTH - NEAR))
    priced = keys.withColumn("branch", branch).repartition("branch").sortWithinPartitions("branch").mapInArrow(
        _priced(uuid.uuid4().hex, model), PRICED)
    known = told.select("block", "word").join(counts, "word", "left").select(
        "block", "word", F.coalesce("c", F.lit(0)).cast("double").alias("value"))
    # a word has its count for a value, a key its cost; written, so that the shuffles behind it go
    every = materialize(known.unionByName(priced, allowMissingColumns=True))
    out = dealt.select("doc_id", "text", "block").groupBy("block").cogroup(every.groupBy("block")).applyInArrow(_score, SCORED)
    all_tokens, distinct = tokens + ends, kinds + (ends > 0)
    end, bottom = math.log10(ends + 0.5), math.log10(all_tokens + 0.5 * (distinct + 1))
    n_tokens = F.col("n_tokens") + 1
    return out.select(
        "doc_id", n_tokens.alias("n_tokens"), (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(end) - n_tokens * F.lit(bottom)).alias("base_score"), "score",
    )
