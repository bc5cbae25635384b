"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A text is parsed
against it: each phrase is the longest match from where the last one ended, found by
following transitions from the initial state until there is none. Few phrases mean
that the text is made of long pieces of that language. For c phrases in a text of n
bytes, against m bytes of labelled text, the cross-parsing entropy is c * log2(m) / n
bits a byte; the language with the least wins (ties: the smaller name).

Automata are fitted on a bounded sample: of each language the rows with the smallest
hash of id and language, at most SAMPLE_ROWS documents and SAMPLE_BYTES bytes of text.
Prediction reads every whole text, cut in pieces of PIECE bytes that are parsed side by
side; a cut costs each language the same one phrase.

Defined cases: null texts and texts without a letter are `und` with score 0; where no
label was learned every text is; rows without a doc_id are left out; null labels are
not learned from; repeated rows are returned as often as they come; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.llm import common
from spreadlake.operators.ordered import top_n_per_group

SAMPLE_ROWS = 64
SAMPLE_BYTES = 32 << 10
PIECE = 256
UNKNOWN = "und"
# Text parsed at once by a task; places of all its pieces are held several times over.
SLICE_BYTES = 1 << 20

PREDICTIONS = "doc_id long, lang_pred string, score double"

# Lower-case letters; other ASCII characters are one space; bytes of other characters stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def folded(text: bytes) -> np.ndarray:
    return _FOLD[np.frombuffer(text, np.uint8)]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring of `text`;
    state 0 is the initial one."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Parser:
    """Automata of all languages as tables over the bytes they use."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.langs = [lang for lang, _ in samples]
        texts = [folded(text) for _, text in samples]
        self.bits = [np.log2(len(t) + 2) for t in texts]
        used = np.unique(np.concatenate([np.empty(0, np.uint8), *texts]))
        # symbols: 0 for bytes no sample has, then the used ones, then the filler after a text
        self.symbol = np.zeros(256, dtype=np.int32)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 2
        self.tables = [self._table(t) for t in texts]

    def _table(self, text: np.ndarray) -> np.ndarray:
        moves = suffix_automaton(self.symbol[text].tolist())
        # row 1 is between phrases, row 2 the initial state; 0 says that there is no transition
        out = np.zeros((len(moves) + 2, self.width), dtype=np.int32)
        for state, to in enumerate(moves):
            out[state + 2, list(to)] = [x + 2 for x in to.values()]
        out[:, -1] = np.arange(len(out))
        return out.ravel() * self.width  # entries are row offsets

    def phrases(self, columns: np.ndarray) -> np.ndarray:
        """Phrases of each piece for each language; columns: symbols by place and piece.
        A symbol that the sample does not hold is a phrase of its own."""
        between, start = np.int32(self.width), np.int32(2 * self.width)
        out = np.zeros((len(self.tables), columns.shape[1]), dtype=np.int64)
        for k, moves in enumerate(self.tables):
            state = np.full(columns.shape[1], between, dtype=np.int32)
            count = np.zeros(columns.shape[1], dtype=np.int32)
            for symbols in columns:
                to = moves[state + symbols]
                stuck = to == 0
                if stuck.any():
                    again = moves[start + symbols[stuck]]
                    to[stuck] = np.where(again == 0, between, again)
                    count += stuck
                state = to
            out[k] = count
        return out

    def entropies(self, text: pa.Array) -> np.ndarray:
        """Bits a byte for each language and text."""
        size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.concatenate([self.symbol[folded(t)] for t in text.cast(pa.binary()).to_pylist()] or [np.empty(0, np.int32)])
        pieces = -(-size // PIECE)
        doc, place = common.spans_of(pieces)
        first = np.cumsum(size) - size
        begin = first[doc] + place * PIECE
        length = np.minimum(PIECE, first[doc] + size[doc] - begin)
        at = begin + np.arange(PIECE)[:, None]
        columns = np.where(np.arange(PIECE)[:, None] < length, np.append(data, 0)[np.minimum(at, len(data))], self.width - 1)
        counts = self.phrases(columns.astype(np.int32))
        total = np.array([np.bincount(doc, weights=c, minlength=len(size)) for c in counts])
        return total * np.array(self.bits)[:, None] / np.maximum(size, 1)


def _languages(samples, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each row's text."""
    langs = np.array([UNKNOWN] * batch.num_rows, dtype=object)
    score = np.zeros(batch.num_rows)
    text = pc.fill_null(batch.column("text"), "")
    letters = np.flatnonzero(pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False))
    known = samples.value
    if known and len(letters):
        parser = common.held(("parser", known), lambda: Parser(known))
        bits = parser.entropies(text.take(pa.array(letters)))
        best = bits.argmin(axis=0)
        langs[letters] = np.array(parser.langs, dtype=object)[best]
        least = np.sort(bits, axis=0)[:2]
        score[letters] = 1.0 if len(parser.langs) == 1 else least[1] / (least[0] + least[1])
    return langs, score


def _predict(samples):
    schema = common.schema_of(PREDICTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.tables_of(batches, limit=SLICE_BYTES):
            langs, score = _languages(samples, batch)
            yield common.rows(schema, batch.column("doc_id"), langs.tolist(), score)

    return run


def _known(samples):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.tables_of(batches, limit=SLICE_BYTES):
            yield batch.filter(pa.array(_languages(samples, batch)[0] != UNKNOWN))

    return run


def labelled_sample(docs: DataFrame, learn: Column) -> tuple[tuple[str, bytes], ...]:
    """(language, text) of the bounded sample, by language."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = F.xxhash64("doc_id", "lang")
    # ids alone are ranked, in slices first, so that a common language is no single task
    ids = rows.select("doc_id", "lang").distinct().withColumn("place", place)
    chosen = top_n_per_group(ids, ["lang"], [F.col("place"), F.col("doc_id")], SAMPLE_ROWS, rank="rank")
    texts = (
        rows.join(F.broadcast(chosen), ["doc_id", "lang"])
        .groupBy("lang", "rank").agg(F.min(F.substring(F.col("text").cast("binary"), 1, SAMPLE_BYTES)).alias("text"))
    )
    out: dict[str, bytes] = {}
    for row in sorted(texts.collect(), key=lambda r: (r["lang"], r["rank"])):
        out[row["lang"]] = (out.get(row["lang"], b"") + b" " + bytes(row["text"]))[:SAMPLE_BYTES]
    return tuple(out.items())


def predict(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; `learn` tells, of `doc_id` alone,
    which documents may be learned from."""
    docs = common.documents(docs, "lang")
    samples = docs.sparkSession.sparkContext.broadcast(labelled_sample(docs, learn))
    return docs.select("doc_id", "text").mapInArrow(_predict(samples), PREDICTIONS)


def reject_unknown(docs: DataFrame, learn: Column) -> DataFrame:
    """The rows that have an id and whose text has a language."""
    samples = docs.sparkSession.sparkContext.broadcast(labelled_sample(common.documents(docs, "lang"), learn))
    return docs.filter(F.col("doc_id").isNotNull()).mapInArrow(_known(samples), docs.schema)
