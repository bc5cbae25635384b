"""Secret scans with multipart credential linking, on built-in expressions only.

Three kinds of strong findings are reported wherever they stand: assignments of secret
words, access identifiers, and long hexadecimal strings. Three kinds of weak parts say
little alone: identifiers (`id`), strings of the length and alphabet of a secret key
(`key`), and endpoints (`endpoint`). Parts are intervals of a text, and two are in one
scope when at most SCOPE code points lie between them. Joining the intervals by scope,
a `key` is reported beside an identifier, an `id` beside a secret, an `endpoint` beside
both: a weak part never by itself.

Matches of a pattern are told apart from what lies between them by splitting the text
at it, and the lengths of both add up to positions. Matches are worked on in chunks of the
square root of their number, as a long text may hold very many. All of it happens inside a row, so
nothing is shuffled and no group can grow hot.

Defined cases: null texts are empty and hold nothing; rows without a doc_id are left
out; repeated rows are returned as often as they come; positions count code points, an
end is exclusive; spans are sorted by start, then kind as in KINDS; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.functions.binding import bind
from spreadlake.llm import common

SCOPE = 200


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # matches, leftmost first, that do not overlap
    group: int  # the part whose length counts
    least: int
    most: int = 1 << 30


KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs are maximal, so shorter ones need not be matched to be left out
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
    Kind("id", r"""(?i)(access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3),
    Kind("key", r"[A-Za-z0-9/+]{40,}", 0, 40, 40),
    Kind("endpoint", r"https?://[A-Za-z0-9.-]+(:[0-9]+)?", 0, 11),
)
STRONG = ("assign", "access", "hex")
# What has to be in scope of a weak part: one of each group.
IDENTIFIERS, SECRETS = ("access", "id"), ("assign", "hex", "key")
BESIDE = {"id": (SECRETS,), "key": (IDENTIFIERS,), "endpoint": (IDENTIFIERS, SECRETS)}

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def _parts(text: Column, kind: Kind) -> Column:
    """What the spans of a kind are made of: the text before each match, the match, and
    the part whose length counts; null where there is no match."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    return F.when(
        text.rlike(kind.pattern),
        F.arrays_zip(F.split(text, kind.pattern, -1).alias("before"), found.alias("found"), counted.alias("counted")))


def _chunks(array: Column) -> Column:
    """The elements in chunks of the square root of their number, so that what costs the
    square of a chunk, or looks at every chunk, stays cheap on a long array."""

    def cut(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / size).cast("int")), lambda c: F.slice(a, c * size + 1, size)))

    return F.coalesce(bind(array, cut), F.array())


def _spans(parts: Column, kind: Kind, rank: int) -> Column:
    """The spans of a kind, from left to right: chunks are placed by the lengths of those
    before, then the parts of each chunk by its own."""
    none = F.array().cast(f"array<{SPAN}>")

    def length(part: Column) -> Column:
        return (F.length(part["before"]) + F.coalesce(F.length(part["found"]), F.lit(0))).cast("bigint")

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["before"])
        end = begin + F.coalesce(F.length(part["found"]), F.lit(0))
        size = F.length(part["counted"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"))
        out = F.when((size >= kind.least) & (size <= kind.most), F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.cast("bigint").alias("at"), out.cast(f"array<{SPAN}>").alias("out"))

    def placed(chunks: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        sizes = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda sum_, part: sum_ + length(part)))
        begins = F.aggregate(
            sizes, F.array(zero), lambda done, size: F.concat(done, F.array(F.get(done, F.size(done) - 1) + size)))
        return bind(begins, lambda at: F.flatten(F.transform(chunks, lambda c, i: F.aggregate(
            c, F.struct(F.get(at, i).alias("at"), none.alias("out")), step)["out"])))

    return F.when(parts.isNull(), none).otherwise(bind(_chunks(parts), placed))


def _beside(span: Column, chunks: Column) -> Column:
    """Whether a span of one of the chunks is in scope of the span."""

    def near(o: Column) -> Column:
        return (o["start"] <= span["end"] + SCOPE) & (o["end"] >= span["start"] - SCOPE)

    return F.exists(chunks, lambda c: near(c) & F.exists(c["spans"], near))


def _bounded(spans: Column) -> Column:
    """Chunks of spans, each with the smallest start and the largest end in it."""
    return F.transform(_chunks(spans), lambda c: F.struct(
        F.array_min(F.transform(c, lambda s: s["start"])).alias("start"), F.array_max(F.transform(c, lambda s: s["end"])).alias("end"), c.alias("spans")))


def _linked(weak: str, groups: tuple[tuple[str, ...], ...]) -> Column:
    """The spans of a weak kind with one of each group in scope."""
    left = F.col(weak)
    for kinds in groups:
        left = bind(_bounded(F.concat(*kinds)), lambda chunks, left=left: F.filter(left, lambda s: _beside(s, chunks)))
    return left


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, strong, linked): arrays of spans (start, rank, end, kind), the strong
    ones and the weak parts found beside what completes them."""
    docs = common.documents(docs)
    text = F.coalesce("text", F.lit(""))
    parts = docs.select("doc_id", *[_parts(text, k).alias(k.name) for k in KINDS])
    spans = parts.select("doc_id", *[_spans(F.col(k.name), k, i).alias(k.name) for i, k in enumerate(KINDS)])
    linked = [_linked(weak, groups) for weak, groups in BESIDE.items()]
    return spans.select(
        "doc_id", F.sort_array(F.concat(*STRONG)).alias("strong"), F.sort_array(F.concat(*linked)).alias("linked"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
