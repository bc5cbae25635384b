"""Best-fit packing of token sequences by bin completion.

Documents are tokenized, ended with one token and, where longer than a sequence, cut
into pieces: the first takes what is left over, all others fill a sequence. What has
to be packed is then a number of pieces for each length, at most `size` numbers
whatever the corpus holds. Bin completion works on those: take the longest piece
left, enumerate the fillings of the rest of its sequence that no other filling
dominates, longest parts first, and keep the fullest; a filling that leaves nothing
ends the search. Branches whose unavoidable waste cannot beat the incumbent are cut.
A best-fit-decreasing filling is the first incumbent, and a filling is used as often
as the numbers allow, so the search runs once for each kind of filling. If the whole
needs more sequences than a lower bound, best-fit decreasing over all lengths is
compared, and the better one is the incumbent of a search over whole plans: it goes
back over the undominated fillings of each longest piece and how often each is used.
That search is exact unless it ends at PLAN_NODES; then the incumbent stays, which may
be above the optimum.

The plan says, for each length, which run of its pieces goes to which filling. Pieces
are numbered within their length in parallel, by counts of each partition, and looked
up in the plan; no task sees more than its share of them.

Defined cases: a null or empty text is one piece holding only the end token; rows
without a doc_id are left out; rows that share a doc_id are packed each on its own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spreadlake.llm import common
from spreadlake.session import materialize

SIZE = 1024
END = 2
# Text encoded at once.
SLICE_BYTES = 1 << 20
# Fillings looked at in one search for the best completion.
NODES = 20_000
# Steps of the search over whole plans, those that list fillings included.
PLAN_NODES = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _tokenizer(path: str):
    # a task has one core; threads beside it would each keep memory of their own
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of texts.

    The word pattern of a byte-level BPE never joins what stands before a single
    space to what follows it. A text is cut at such spaces, and equal parts are
    encoded once: new ones together, and told apart by the bytes of their tokens. A text that
    holds an added token, such as a marker of the end of a text, is encoded as it is.
    """

    # A space at an end of the text or beside other white space.
    ODD = r"^ | $| [\s\x0B\x1C-\x1F\x{85}\p{Z}]|[\s\x0B\x1C-\x1F\x{85}\p{Z}] "
    # Parts encoded in one call, and parts remembered by a worker (by 64-bit hashes, some
    # 40 bytes each).
    JOINED = 2000
    KEPT = 1_000_000
    CALL_CHARS = 128 << 10

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)  # one character for each byte
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.place = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.pool, self.first, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each), from calls of some
        CALL_CHARS each: what the tokenizer tells of a token takes far more than its id."""
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        upto = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + self.CALL_CHARS, side="right")))
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts[at:stop], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes[-1].sum())))
            at = stop
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, parts: list[str], hashes: np.ndarray) -> None:
        """Remember the ids of " " + part for each part."""
        spaced = [" " + p for p in parts]
        ids, _ = self._encode(["".join(spaced[i:i + self.JOINED]) for i in range(0, len(spaced), self.JOINED)])
        stop = np.cumsum(pc.binary_length(pa.array(spaced)).to_numpy().astype(np.int64))
        upto = np.searchsorted(np.cumsum(self.bytes[ids]), stop, side="right")
        hashes = np.concatenate([self.hashes, hashes])
        place = np.concatenate([self.place, np.arange(len(self.place), len(hashes), dtype=np.int32)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.place = hashes[order], place[order]
        self.pool = np.concatenate([self.pool, ids])
        self.first = np.concatenate([self.first, len(self.pool) - len(ids) + np.r_[0, upto[:-1]]])
        self.size = np.concatenate([self.size, np.diff(upto, prepend=0)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text)."""
        odd = pc.match_substring_regex(texts, self.ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts)
        split = pc.split_pattern(plain, " ")
        per = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        head = np.cumsum(per) - per
        coded = split.flatten().dictionary_encode()
        parts, code = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
        # a text's first part has no space before it; odd texts are one part
        rest = np.ones(len(code), bool)
        rest[head] = False
        asked = np.zeros(len(parts), bool)
        asked[code[rest]] = True
        used = np.flatnonzero(asked)
        if len(self.hashes) + len(used) > self.KEPT:
            self._forget()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(parts[i]) for i in used), dtype=np.uint64, count=len(used))
        at = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero(np.append(self.hashes, np.uint64(0))[at] != hashes) if len(self.hashes) else np.arange(len(used))
        if len(new):
            self._learn([parts[used[i]].decode() for i in new], hashes[new])
        known = np.zeros(len(parts), dtype=np.int64)
        if len(used):
            known[used] = self.place[np.searchsorted(self.hashes, hashes)]
        whole = texts.to_pylist() if odd.any() else None
        alone, alone_size = self._encode([whole[i] if odd[i] else parts[code[h]].decode() for i, h in enumerate(head)])
        base = len(self.pool)
        first = np.empty(len(code), dtype=np.int64)
        size = np.empty(len(code), dtype=np.int64)
        if len(used):
            at = known[code[rest]]
            first[rest], size[rest] = self.first[at], self.size[at]
        first[head], size[head] = base + np.cumsum(alone_size) - alone_size, alone_size
        which, place = common.spans_of(size)
        doc = np.repeat(np.arange(len(texts)), per)
        at = first[which] + place
        ids = np.empty(len(at), np.uint32)
        own = at < base
        ids[own], ids[~own] = self.pool[at[own]], alone[at[~own] - base]
        return ids, np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)


def _encoder(path: str) -> Encoder:
    """An encoder in place of what the worker held before, which is given back first."""
    common.give_back()
    return Encoder(path)


def _pieces(path: str, size: int):
    schema = common.schema_of(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.held(("encoder", path), lambda: _encoder(path))
        for batch in common.tables_of(batches, limit=SLICE_BYTES):
            texts = pc.fill_null(batch.column("text"), "")
            ids, count = encoder.encode(texts)
            doc = np.repeat(np.arange(len(count)), count)
            ended = np.full(len(ids) + len(count), END, dtype="<u4")
            ended[np.arange(len(ids)) + doc] = ids
            total = count + 1
            pieces = -(-total // size)
            of, piece = common.spans_of(pieces)
            short = total - (pieces - 1) * size  # the first piece
            start = np.where(piece == 0, 0, short[of] + (piece - 1) * size)
            length = np.where(piece == 0, short[of], size)
            begin = (np.cumsum(total) - total)[of] + start
            crc = [zlib.crc32(ended[a:a + n]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            yield common.rows(schema, batch.column("doc_id").take(pa.array(of)), piece, start, length, np.array(crc, np.int64))

    return run


def _greedy(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """Best fit: the longest piece that fits, again and again."""
    out = []
    at = room
    while room:
        below = np.flatnonzero(counts[: min(at, room) + 1])
        if not len(below) or below[-1] == 0:
            break
        n = int(below[-1])
        times = int(min(counts[n], room // n))
        out.append((n, times))
        room -= n * times
        at = n - 1
    return out


def _waste(filling: list[tuple[int, int]], room: int) -> int:
    return room - sum(n * times for n, times in filling)


def complete(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The fullest set of pieces for `room`, as (length, times), longest first."""
    best = _greedy(counts, room)
    least = _waste(best, room)
    if not least or not room:
        return best
    lengths = [int(n) for n in np.flatnonzero(counts)[::-1] if 0 < n <= room]
    # what the pieces from here on hold together bounds what a branch can still fill
    held = np.cumsum([n * int(counts[n]) for n in lengths][::-1])[::-1].tolist() + [0]
    stack = [(0, room, ())]
    looked = 0
    while stack and looked < NODES:
        at, left, chosen = stack.pop()
        looked += 1
        if left < least:
            best, least = list(chosen), left
            if not left:
                break
        while at < len(lengths) and lengths[at] > left:
            at += 1
        if at == len(lengths) or left - held[at] >= least:
            continue
        n = lengths[at]
        most = min(int(counts[n]), left // n)
        # pushed with fewer of the longest first, so that more of it is tried first
        for times in range(most + 1):
            # leaving out a piece that fits is dominated unless others use its room
            if times < most and left - times * n - held[at + 1] >= least:
                continue
            stack.append((at + 1, left - times * n, (*chosen, (n, times)) if times else chosen))
    return best


def _fillings(left: dict[int, int], room: int) -> Iterator[list[tuple[int, int]] | None]:
    """Every maximal filling of `room` with the pieces left, longest first: one to which
    no piece left can be added. A filling that is not maximal is dominated by one that is.
    Each step on the way is a None, to be counted."""
    lengths = sorted((n for n, k in left.items() if k and 0 < n <= room), reverse=True)
    stack = [(0, room, ())]
    while stack:
        yield None
        at, rest, chosen = stack.pop()
        while at < len(lengths) and lengths[at] > rest:
            at += 1
        if at == len(lengths):
            used = dict(chosen)
            if all(n > rest or used.get(n, 0) == left[n] for n in lengths):
                yield list(chosen)
            continue
        n = lengths[at]
        for times in range(min(left[n], rest // n) + 1):
            stack.append((at + 1, rest - times * n, (*chosen, (n, times)) if times else chosen))


def _improved(counts: np.ndarray, size: int, best: list) -> list:
    """A plan of fewer sequences than `best`, or `best`. Sequences are filled in the order
    of their longest piece; a plan stands for all orders of its sequences."""
    total = int((np.arange(len(counts)) * counts).sum())
    fewest = sum(t for _, t in best)
    bound = -(-total // size)
    start = {int(n): int(counts[n]) for n in np.flatnonzero(counts)}
    looked = 0

    def branches(left: dict[int, int], held: int, used: int):
        nonlocal looked
        n = max(left)
        left[n] -= 1
        found = []
        for rest in _fillings(left, size - n):
            looked += 1
            if looked >= PLAN_NODES:
                break
            if rest is not None:
                uses = {n: 1}
                for k, times in rest:
                    uses[k] = uses.get(k, 0) + times
                found.append((sum(k * t for k, t in uses.items()), uses))
        left[n] += 1
        # the fullest first, and each as often as it goes first
        for full, uses in sorted(found, key=lambda f: -f[0]):
            for often in range(min(left[k] // t for k, t in uses.items()), 0, -1):
                rest = {k: c - often * uses.get(k, 0) for k, c in left.items()}
                yield {k: c for k, c in rest.items() if c}, held - often * full, used + often, (uses, often)

    steps = [branches(start, total, 0)]
    path: list = []
    seen: dict = {}
    while steps and fewest > bound and looked < PLAN_NODES:
        step = next(steps[-1], None)
        if step is None:
            steps.pop()
            if path:
                path.pop()
            continue
        looked += 1
        left, held, used, taken = step
        if used + -(-held // size) >= fewest:
            continue
        if not left:
            fewest, best = used, [(sorted(u.items(), reverse=True), t) for u, t in [*path, taken]]
            continue
        key = tuple(left.items())
        if seen.get(key, fewest) <= used:
            continue
        seen[key] = used
        path.append(taken)
        steps.append(branches(left, held, used))
    return best


def plan(counts: np.ndarray, size: int = SIZE, search: bool = True) -> list[tuple[list[tuple[int, int]], int]]:
    """Fillings and how often each is used, for counts[n] pieces of each length n."""
    left = np.array(counts, dtype=np.int64)
    out = []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            break
        n = int(lengths[-1])
        left[n] -= 1
        rest = (complete if search else _greedy)(left, size - n)
        left[n] += 1
        uses: dict[int, int] = {n: 1}
        for k, times in rest:
            uses[k] = uses.get(k, 0) + times
        often = min(int(left[k]) // times for k, times in uses.items())
        for k, times in uses.items():
            left[k] -= often * times
        out.append((sorted(uses.items(), reverse=True), often))
    if search and sum(t for _, t in out) > -(-int((np.arange(len(counts)) * counts).sum()) // size):
        other = plan(counts, size, search=False)
        if sum(t for _, t in other) < sum(t for _, t in out):
            out = other
        out = _improved(np.array(counts, dtype=np.int64), size, out)
    return out


def _runs(fillings, size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first and end rank, pieces in a sequence, first sequence, first offset)."""
    rank, sequence, out = {}, 0, []
    for parts, often in fillings:
        offset = 0
        for n, times in parts:
            first = rank.get(n, 0)
            out.append((n, first, first + often * times, times, sequence, offset))
            rank[n] = first + often * times
            offset += n * times
        sequence += often
    return out


def _ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """`rank` from 0 within each length. A length is counted in groups of bounded size."""
    groups = max(1, rows // 100_000)
    split = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = split.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inside")).drop(
        "part", "inside", "before")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece;
    `tokenizer` is the path of a byte-level BPE file on every executor."""
    docs = common.documents(docs)
    spark: SparkSession = docs.sparkSession
    pieces = materialize(docs.mapInArrow(_pieces(tokenizer, size), PIECES))
    counts = np.zeros(size + 1, dtype=np.int64)
    for n, rows in pieces.groupBy("length").count().collect():  # one row for each length at most
        counts[n] = rows
    runs = spark.createDataFrame(
        _runs(plan(counts, size), size) or [(0, 0, 0, 1, 0, 0)],
        "length long, low long, high long, times long, first_sequence long, first_offset long",
    )
    # few runs for each length: what one filling uses up ends a length
    ranked = _ranked(pieces, int(counts.sum())).join(F.broadcast(runs), "length").filter("rank >= low AND rank < high")
    at = F.col("rank") - F.col("low")
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + at % F.col("times") * F.col("length")).cast("long").alias("offset"),
    )
