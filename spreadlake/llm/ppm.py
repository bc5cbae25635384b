"""Prediction by partial matching: a byte-context trie of the corpus scores texts.

A text is its tokens: its words (`[^\x20\x09-\x0D]+`, A-Z in lower case), then one
end, which is a word of no bytes. A word is coded byte by byte, then a terminator. The
longest context of the trie is the whole word so far, followed to the word's end: a
word seen in training costs its own frequency, less a discount. What is discounted is
the escape, estimated from the words seen once and twice. After an escape the word is
spelled in shorter contexts, of up to ORDER bytes within the word: a symbol is coded
in the longest context that has been followed by it; contexts in which it was never
seen are escaped from (an escape is as likely as the number of distinct symbols seen
there against that number plus their count), and the symbols seen in a context escaped
from are excluded below it. Under the empty context all symbols are equally likely.
The shorter contexts are counted with update exclusion: a word counts there once, when
it is new to the longest context.

There is one such trie for each of the most frequent labels of the training texts (at
most PARTS, the last one for all others), and a text's probability is that of their
mixture, weighted by their training texts: the text itself tells which of them it
follows. Labels are never read of the text that is scored.

Whole words grow with the corpus and are joined, not broadcast: texts are dealt to
blocks of bounded bytes, each block asks once for each of its words and gets back their
counts. Short contexts are read through CLASSES classes of bytes (letters and the space
keep their own, other bytes share a few), which bounds them by CLASSES ** ORDER contexts
of 256 symbols whatever the corpus holds; only they are broadcast. All counts come from
every training text.

`pretrained` scores each text with that trie as it stands; `adaptive_score` codes one
text with a trie that starts empty and learns as it codes.

Defined cases: null texts are empty; an empty text is one end; rows without a doc_id
are left out; repeated rows each count and are each returned; with no training text
every symbol is equally likely; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.llm import common, words
from spreadlake.session import materialize

ORDER = 3
CLASSES = 32
SYMBOLS = 256
STOP = 32  # ends a word
PARTS = 8
BLOCK_BYTES = 16 << 20
CONTEXTS = CLASSES**ORDER

TRIE = "trie long, n long"
SCORED = "doc_id long, n_tokens long, n_known long, logs double, score double"

# 26 letters, start and end of a word, digits, other ASCII, and three classes of other bytes
_CLASS = np.full(SYMBOLS, 28, dtype=np.int64)
_CLASS[97:123] = np.arange(26)
_CLASS[STOP], _CLASS[48:58] = 26, 27
_CLASS[128:] = 29 + np.arange(128, SYMBOLS) % 3


def _spelled(each: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, symbol, word) for every byte of every word and its terminator."""
    size = pc.binary_length(each).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(each.cast(pa.binary()).to_pylist()), np.uint8)
    # ORDER terminators stand between words, the first of them belongs to the word before
    of = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(data)) + ORDER * (of + 1)
    symbols = np.full(len(data) + ORDER * (len(size) + 1), STOP, dtype=np.uint8)
    symbols[at] = data
    places = np.concatenate([at, np.cumsum(size) + ORDER * np.arange(1, len(size) + 1)])
    classes = _CLASS[symbols]
    context = np.zeros(len(places), dtype=np.int64)
    for back in range(ORDER, 0, -1):
        context = context * CLASSES + classes[places - back]
    return context, symbols[places].astype(np.int64), np.concatenate([of, np.arange(len(size))])


def counted(parts: int) -> str:
    return "block int, word string, " + ", ".join(f"n{k} long" for k in range(parts))


def _words_of_blocks(parts: int):
    """Each block's words with their training counts in each part; rows come block by
    block. A text that isn't learned from has no part."""
    schema = common.schema_of(counted(parts))
    names = [f"n{k}" for k in range(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked = None, None

        def rows():
            return common.rows(schema, np.full(len(asked), block), *[asked.column(c).combine_chunks() for c in ("word", *names)])

        for batch in common.tables_of(batches):
            of = batch.column("block").to_numpy()
            cut = np.flatnonzero(of[1:] != of[:-1]) + 1
            for start, stop in zip(np.r_[0, cut], np.r_[cut, len(of)], strict=True):
                texts = batch.slice(start, stop - start)
                if of[start] != block:
                    if asked is not None:
                        yield rows()
                    block, asked = of[start], None
                part = pc.fill_null(texts.column("part"), -1).to_numpy(zero_copy_only=False)
                w = words.words_of(texts.column("text"), lower=True)
                coded = w.flat.dictionary_encode()
                code, kinds = coded.indices.to_numpy(), len(coded.dictionary)
                counts = {n: np.bincount(code[part[w.doc] == k], minlength=kinds) for k, n in enumerate(names)}
                seen = pa.table({"word": coded.dictionary, **{n: pa.array(c, pa.int64()) for n, c in counts.items()}})
                if asked is not None:
                    seen = pa.concat_tables([asked, seen])
                asked = seen.group_by("word").aggregate([(n, "sum") for n in names]).rename_columns(["word", *names])
        if asked is not None:
            yield rows()

    return run


def _contexts(parts: int):
    """Counts of (part, context, symbol) over words that each count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [np.zeros(CONTEXTS * SYMBOLS, dtype=np.int32) for _ in range(parts)]
        for batch in common.tables_of(batches, "word"):
            context, symbol, of = _spelled(batch.column("word"))
            for k, trie in enumerate(tries):
                mine = (batch.column(f"n{k}").to_numpy() > 0)[of]
                keys, times = np.unique(context[mine] * SYMBOLS + symbol[mine], return_counts=True)
                trie[keys] += times.astype(np.int32)
        for k, trie in enumerate(tries):
            keys = np.flatnonzero(trie)
            yield common.rows(common.schema_of(TRIE), keys + k * CONTEXTS * SYMBOLS, trie[keys].astype(np.int64))

    return run


def trie_costs(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol in each context of ORDER classes, escapes and
    exclusions included."""
    orders = [np.bincount(keys, weights=counts, minlength=CONTEXTS * SYMBOLS).reshape(CONTEXTS, SYMBOLS)]
    for order in range(ORDER - 1, -1, -1):  # the shorter context is the longer one without its oldest class
        orders.append(orders[-1].reshape(CLASSES, CLASSES**order, SYMBOLS).sum(axis=0))

    def coded(context: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        cost = np.zeros((len(context), SYMBOLS))
        open_ = np.ones((len(context), SYMBOLS), dtype=bool)
        escape = np.zeros(len(context))
        for seen in tables:
            here = seen[context % len(seen)]
            fits = open_ & (here > 0)
            distinct = fits.sum(axis=1)
            total = np.where(fits, here, 0).sum(axis=1) + distinct
            with np.errstate(divide="ignore"):
                cost = np.where(fits, escape[:, None] + np.log10(here / np.maximum(total, 1)[:, None]), cost)
                escape = escape + np.where(distinct > 0, np.log10(distinct / np.maximum(total, 1)), 0.0)
            open_ &= ~fits
        left = open_.sum(axis=1)
        return np.where(open_, (escape - np.log10(np.maximum(left, 1)))[:, None], cost)

    # contexts never met are those of one byte less
    shorter = coded(np.arange(CONTEXTS // CLASSES), orders[1:]).astype(np.float32)
    costs = np.tile(shorter, (CLASSES, 1))
    met = np.flatnonzero(orders[0].any(axis=1))
    for at in range(0, len(met), 1024):
        costs[met[at:at + 1024]] = coded(met[at:at + 1024], orders)
    return costs.ravel()


def spelling(each: pa.Array, costs: np.ndarray) -> np.ndarray:
    """log10 probability of each word spelled in the short contexts."""
    context, symbol, of = _spelled(each)
    return np.bincount(of, weights=costs[context * SYMBOLS + symbol], minlength=len(each))


def _costs(parts: int, trie) -> list[np.ndarray]:
    """One table of costs for each part."""
    keys, counts = trie.value
    of = keys // (CONTEXTS * SYMBOLS)
    return [trie_costs(keys[of == k] % (CONTEXTS * SYMBOLS), counts[of == k]) for k in range(parts)]


@dataclass(frozen=True)
class Part:
    """What a part's words add up to."""

    weight: float  # share of the training texts
    tokens: int
    discount: float
    escape: float
    ends: int

    def logs(self, count: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 probability of words from their counts and spellings."""
        seen = np.maximum(count - self.discount, 0) / max(self.tokens, 1)
        out = np.log10(seen + self.escape * 10.0 ** np.maximum(spelled, -300))
        # a word too long for a float's range keeps its spelling's logarithm
        return np.where((seen == 0) & (spelled < -290), spelled + math.log10(self.escape), out)


def _score(name: str, trie, parts: list[Part]):
    schema = common.schema_of(SCORED)

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        costs = common.held(("costs", name), lambda: _costs(len(parts), trie))
        names = pa.concat_arrays([pa.array([], pa.string()), *asked.column("word").chunks])
        counts = [np.append(asked.column(f"c{k}").to_numpy(), 0) for k in range(len(parts))]
        out = []
        for batch in common.tables_of(docs.to_batches()):
            w = words.words_of(batch.column("text"), lower=True)
            coded = w.flat.dictionary_encode()
            code = coded.indices.to_numpy()
            at = pc.fill_null(pc.index_in(coded.dictionary, value_set=names), len(names)).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            c = sum(x[at] for x in counts)
            known = np.bincount(w.doc, weights=(c > 0)[code], minlength=n).astype(np.int64)
            logs = np.bincount(w.doc, weights=np.log10(c + 0.5)[code], minlength=n)
            scores = []
            for part, cost, count in zip(parts, costs, counts, strict=True):
                each = part.logs(count[at], spelling(coded.dictionary, cost))
                end = part.logs(np.array([part.ends]), spelling(pa.array([""]), cost))[0]
                scores.append(np.bincount(w.doc, weights=each[code], minlength=n) + end + math.log10(part.weight))
            best = np.max(scores, axis=0)
            score = best + np.log10(np.sum(10.0 ** (np.array(scores) - best), axis=0))
            out.append(common.rows(schema, batch.column("doc_id"), w.count, known, logs, score))
        return pa.Table.from_batches(out, schema=schema)

    return run


def pretrained(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document;
    `learn` tells, of `doc_id` alone, which documents are learned from. The base is the
    unigram score with half a count added."""
    docs = common.documents(docs, "lang")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    label = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    labels = docs.filter(learn).groupBy(label.alias("label")).count().orderBy(F.desc("count"), "label").limit(PARTS - 1)
    own = {r["label"]: r["count"] for r in labels.collect()}
    ends = docs.filter(learn).count()
    texts = [*own.values(), *([ends - sum(own.values())] if ends > sum(own.values()) or not own else [])]
    part = F.lit(len(own))
    for k, name in enumerate(own):
        part = F.when(label == name, k).otherwise(part)
    dealt = docs.select("doc_id", "text", F.when(learn, part).alias("part"),
                        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    n = len(texts)
    asked = materialize(
        dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_words_of_blocks(n), counted(n)))
    counts = materialize(
        asked.groupBy("word").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(n)])
        .filter(" OR ".join(f"n{k} > 0" for k in range(n)))
    )
    seen = counts.agg(
        F.count(F.lit(1)).alias("words"),
        *[f(F.col(f"n{k}")).alias(f"{x}{k}") for k in range(n) for x, f in
          (("tokens", F.sum), ("kinds", lambda c: F.count_if(c > 0)), ("once", lambda c: F.count_if(c == 1)),
           ("twice", lambda c: F.count_if(c == 2)))],
    ).first()
    parts = []
    for k, own_ends in enumerate(texts):
        tokens = (seen[f"tokens{k}"] or 0) + own_ends
        discount = max(0.1, seen[f"once{k}"] / max(1, seen[f"once{k}"] + 2 * seen[f"twice{k}"]))
        escape = discount * (seen[f"kinds{k}"] + (own_ends > 0)) / tokens if tokens else 1.0
        parts.append(Part(own_ends / ends if ends else 1.0, tokens, discount, escape, own_ends))
    trie = counts.mapInArrow(_contexts(n), TRIE).groupBy("trie").agg(F.sum("n").alias("n")).toArrow()
    model = spark.sparkContext.broadcast((trie.column("trie").to_numpy(), trie.column("n").to_numpy()))
    known = asked.select("block", "word").join(
        counts.select("word", *[F.col(f"n{k}").alias(f"c{k}") for k in range(n)]), "word")
    scored = dealt.select("doc_id", "text", "block").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _score(uuid.uuid4().hex, model, parts), SCORED)
    all_tokens, distinct = sum(p.tokens for p in parts), seen["words"] + (ends > 0)
    end, bottom = math.log10(ends + 0.5), math.log10(all_tokens + 0.5 * (distinct + 1))
    n_tokens = F.col("n_tokens") + 1
    return scored.select(
        "doc_id", n_tokens.alias("n_tokens"), (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(end) - n_tokens * F.lit(bottom)).alias("base_score"), "score",
    )


def adaptive_score(text: str | None) -> float:
    """log10 probability of one text under a trie that starts empty and learns as it codes."""
    symbols = [x for w in (text or "").encode().lower().split() for x in (*w, STOP)] + [STOP]
    trie: dict[tuple, Counter] = {}
    past = (STOP,) * ORDER
    total = 0.0
    for s in symbols:
        out: set[int] = set()
        for order in range(ORDER, -1, -1):
            seen = trie.get(past[ORDER - order:], {})
            here = {k: n for k, n in seen.items() if k not in out}
            if here:
                weight = sum(here.values()) + len(here)
                if s in here:
                    total += math.log10(here[s] / weight)
                    break
                total += math.log10(len(here) / weight)
                out |= set(here)
        else:
            total -= math.log10(SYMBOLS - len(out))
        for order in range(ORDER + 1):
            trie.setdefault(past[ORDER - order:], Counter())[s] += 1
        past = (*past[1:], s)
    return total
