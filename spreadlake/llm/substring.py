"""Substring dedup by level-wise doubling.

A window is `window` consecutive words of one document. A word is removed when it
lies in a window whose words also start earlier: in a document with a smaller id,
or earlier in the same document. Windows are judged on the input.

Level 1 looks at sequences of half the window. Of the half-length sequences inside
a window the one with the smallest hash is its anchor; equal windows have equal
anchors, so only anchors (about two in `half + 2` positions) are compared over the
corpus, and windows whose anchor occurs once are done. Neighbouring windows with one
anchor form a context of at most `half + 1` windows. Rows are dealt by anchor and
sorted: an occurrence of a context that occurred earlier is a repeat as a whole, and
only the first occurrences of contexts that share an anchor with another context are
extended to level 2. There the windows of twice the length are hashed, dealt and
compared one by one. Copies met in one slice of a task are settled before any shuffle.

Sequences are compared by two independent 64-bit hashes.

Defined cases: null or blank texts have no words; a document of fewer than `window`
words loses none; rows without a doc_id are left out; rows that share a doc_id are
one document to the comparison (none of them is earlier than the other) and each is
returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from spreadlake.llm import common, words
from spreadlake.session import materialize

BLOCK_BYTES = 8 << 20

ANCHORS = "anchor long, context long, doc_id long, start long, n long, known boolean"
RANGES = "doc_id long, start long, n long, open boolean"
WINDOWS = "w1 long, w2 long, doc_id long, start long, known boolean"
KEPT = "doc_id long, n_words long, n_removed long, text string"


def _later(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows of one slice whose keys also occur in it at a smaller (doc, start)."""
    order = np.lexsort((start, doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    same = (doc[order] == doc[order][head]) & (start[order] == start[order][head])
    out = np.zeros(len(order), bool)
    out[order] = ~same
    return out


def _anchors(window: int):
    half = math.ceil(window / 2)
    schema = common.schema_of(ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.tables_of(batches):
            w = words.words_of(batch.column("text"))
            if len(w.doc) < window:
                continue
            ids = batch.column("doc_id").to_numpy()
            h1, h2 = words.word_hashes(w.flat, 0), words.word_hashes(w.flat, 1)
            smallest = words.mixed(words.sequence_hashes(h1, half))
            whole = words.sequence_hashes(h2, window)
            # leftmost smallest half-length sequence of each window, by doubling the span looked at
            at = np.arange(len(smallest), dtype=np.int64)
            span, need = 1, window - half + 1
            while span < need:
                step = min(span, need - span)
                less = smallest[step:] < smallest[:-step]
                at = np.where(less, at[step:], at[:-step])
                smallest = np.where(less, smallest[step:], smallest[:-step])
                span += step
            inside = np.flatnonzero(w.doc[: len(whole)] == w.doc[window - 1:])
            if not len(inside):
                continue
            anchor_at = at[inside]
            new = np.r_[True, (np.diff(anchor_at) != 0) | (np.diff(inside) != 1)]
            head = np.flatnonzero(new)
            n = np.diff(np.r_[head, len(inside)])
            first, anchor = inside[head], smallest[inside][head]
            last = first + n - 1
            with np.errstate(over="ignore"):
                context = words.mixed(
                    whole[first] * words.power(3) + whole[last] * words.power(1)
                    + ((anchor_at[head] - first) * 64 + n).astype(np.uint64)
                )
            row = w.doc[first]
            doc, start = ids[row], first - w.first[row]
            known = _later([anchor, context], doc, start)
            # settled rows are dealt by place, so that no key carries them all
            anchor = np.where(known, words.mixed(doc.astype(np.uint64) + start.astype(np.uint64)), anchor)
            yield common.rows(schema, anchor.view(np.int64), context.view(np.int64), doc, start, n, known)

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, context, doc, start): repeats of a context, and first
    occurrences of contexts that share their anchor with another context."""
    schema = common.schema_of(RANGES)
    # the last context's key and first place, and its head row if no neighbour is known yet
    last, waiting = None, None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "context", "doc_id", "start", "n", "known")]
        known = cols[5]
        if known.any():
            yield common.rows(schema, *[c[known] for c in cols[2:5]], np.zeros(int(known.sum()), bool))
            cols = [c[~known] for c in cols]
        anchor, context, doc, start, n, _ = cols
        if not len(anchor):
            continue
        new = np.r_[last is None or (anchor[0], context[0]) != last[:2],
                    (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])]
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        first_doc = np.where(head >= 0, doc[head], last[2] if last else 0)
        first_start = np.where(head >= 0, start[head], last[3] if last else 0)
        repeat = (doc != first_doc) | (start != first_start)
        heads = np.flatnonzero(new)
        if len(heads):
            h_anchor = anchor[heads]
            before = np.r_[last is not None and last[0] == h_anchor[0], h_anchor[1:] == h_anchor[:-1]]
            after = np.r_[h_anchor[:-1] == h_anchor[1:], False]
            if waiting is not None and before[0]:
                yield common.rows(schema, *[np.array([x]) for x in waiting], np.ones(1, bool))
            waiting = None
            opened = heads[before | after]
            if not (before[-1] or after[-1]):
                i = heads[-1]
                waiting = (doc[i], start[i], n[i])
            yield common.rows(schema, doc[opened], start[opened], n[opened], np.ones(len(opened), bool))
        last = (anchor[-1], context[-1], first_doc[-1], first_start[-1])
        yield common.rows(schema, doc[repeat], start[repeat], n[repeat], np.zeros(int(repeat.sum()), bool))


def _table_words(docs: pa.Table) -> tuple[np.ndarray, words.Words]:
    text = docs.column("text").combine_chunks()
    text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
    return docs.column("doc_id").to_numpy(), words.words_of(text)


def _rows_of(ids: np.ndarray, ranges: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, n) for each range and each row of that document."""
    order = np.argsort(ids, kind="stable")
    doc = ranges.column("doc_id").to_numpy()
    low, high = np.searchsorted(ids[order], doc, "left"), np.searchsorted(ids[order], doc, "right")
    which, place = common.spans_of(high - low)
    return order[low[which] + place], ranges.column("start").to_numpy()[which], ranges.column("n").to_numpy()[which]


def _extend(window: int):
    schema = common.schema_of(WINDOWS)

    def run(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        if not docs.num_rows or not ranges.num_rows:
            return schema.empty_table()
        ids, w = _table_words(docs)
        whole = [words.sequence_hashes(words.word_hashes(w.flat, seed), window) for seed in (0, 1)]
        row, start, n = _rows_of(ids, ranges)
        which, place = common.spans_of(n)
        row, start = row[which], start[which] + place
        ok = start + window <= w.count[row]
        row, start = row[ok], start[ok]
        w1, w2 = (x[w.first[row] + start] for x in whole)
        doc = ids[row]
        known = _later([w1, w2], doc, start)
        with np.errstate(over="ignore"):
            w1 = np.where(known, words.mixed(doc.astype(np.uint64) + start.astype(np.uint64)), w1)
        return pa.Table.from_batches([common.rows(schema, w1.view(np.int64), w2.view(np.int64), doc, start, known)])

    return run


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (w1, w2, doc, start): those that are not the first of their window."""
    schema = common.schema_of("doc_id long, start long, n long")
    last = None
    for batch in batches:
        w1, w2, doc, start, known = [batch.column(c).to_numpy(zero_copy_only=False) for c in
                                     ("w1", "w2", "doc_id", "start", "known")]
        out = known.copy()
        i = np.flatnonzero(~known)
        if len(i):
            a, b, d, s = w1[i], w2[i], doc[i], start[i]
            new = np.r_[last is None or (a[0], b[0]) != last[:2], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            first_doc = np.where(head >= 0, d[head], last[2] if last else 0)
            first_start = np.where(head >= 0, s[head], last[3] if last else 0)
            out[i] = (d != first_doc) | (s != first_start)
            last = (a[-1], b[-1], first_doc[-1], first_start[-1])
        yield common.rows(schema, doc[out], start[out], np.ones(int(out.sum()), np.int64))


def _keep(window: int):
    schema = common.schema_of(KEPT)

    def run(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        ids, w = _table_words(docs)
        total = len(w.doc)
        row, start, n = _rows_of(ids, ranges)
        begin = w.first[row] + start
        stop = np.minimum(begin + n + window - 1, w.first[row] + w.count[row])
        covered = np.cumsum(np.bincount(begin, minlength=total + 1) - np.bincount(stop, minlength=total + 1))[:total]
        keep = covered == 0
        kept = np.bincount(w.doc[keep], minlength=len(ids)).astype(np.int64)
        offsets = pa.array(np.r_[0, np.cumsum(kept)].astype(np.int32))
        text = pc.binary_join(pa.ListArray.from_arrays(offsets, w.flat.filter(pa.array(keep))), " ")
        return pa.Table.from_batches([common.rows(schema, ids, w.count, w.count - kept, text)])

    return run


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words kept of every document, joined
    by one space."""
    docs = common.documents(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    dealt = docs.select("doc_id", "text", block)
    settled = materialize(
        docs.mapInArrow(_anchors(window), ANCHORS)
        .repartition("anchor").sortWithinPartitions("anchor", "context", "doc_id", "start")
        .mapInArrow(_settle, RANGES)
    )
    opened = settled.filter("open").select("doc_id", "start", "n", block)
    repeats = settled.filter("NOT open").select("doc_id", "start", "n")
    later = (
        dealt.groupBy("block").cogroup(opened.groupBy("block")).applyInArrow(_extend(window), WINDOWS)
        .repartition("w1").sortWithinPartitions("w1", "w2", "doc_id", "start")
        .mapInArrow(_later_windows, "doc_id long, start long, n long")
    )
    removed = repeats.unionByName(later).select("*", block)
    return dealt.groupBy("block").cogroup(removed.groupBy("block")).applyInArrow(_keep(window), KEPT)
