"""Line dedup by an exact set-similarity join, on built-in expressions only.

The tokens of a line are its distinct shingles of `words` consecutive words (a shorter
line is one shingle). Two lines match when the Jaccard similarity of their token sets
is at least `threshold`; a line that matches an earlier one (smaller doc_id, or same
document and earlier line) is removed, whether or not that one stays.

A line's tokens are ordered by rarity: by the key of their first word, which is the
class of its slot in a table of SLOTS word counts over all texts (its size does not
depend on the input) and bits of its hash; then by the token's own hash. All of that
is one long, by which tokens are compared. Two matching lines share one of their first
n - ceil(t * n) + 1 tokens, so only those are compared (prefix filter). The prefix is
cut by keys: it holds every token whose first word is among so many of the line's
smallest keys. Only tokens of the prefix are hashed, and a token that no second line
has in its prefix leads nowhere.

Lines with the same text are settled first; only the earliest of them goes on. Every
line is then held against one line: of the earliest lines of its prefix tokens the one
it shares most of them with, which settles most near copies without pairing them with
each other. Only lines left are held against all earlier lines with a common prefix
token. Pairs pass the length and
the positional filter before their whole token sets are compared.

Defined cases: null and empty texts have no lines; lines without a word hold no token
and stay; rows without a doc_id are left out; rows that share a doc_id are one
document and should be equal; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from spreadlake.functions.binding import bind
from spreadlake.llm import common
from spreadlake.session import materialize

WORDS = 5
THRESHOLD = 0.8
SLOTS = 1 << 16


def split(text: Column) -> Column:
    """The words of a text; a plain split where the space is the only white space."""
    other = [F.contains(text, F.lit(c)) for c in "\t\n\x0b\x0c\r"]
    parts = F.when(reduce(lambda a, b: a | b, other), F.split(text, common.SPACES)).otherwise(F.split(text, " "))
    return F.array_remove(parts, "")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text) of every line that has a word."""
    each = common.documents(docs).filter("text <> ''").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return each.filter(F.col("text").rlike(common.WORD))


def _slot(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(SLOTS - 1))


def slot_classes(docs: DataFrame) -> list[int]:
    """The class (log of the count, in quarters) of every slot of word hashes, where a
    key has it."""
    # the outer form, so that no filter splits the texts a second time
    words = common.documents(docs).select(F.explode_outer(split(F.col("text"))).alias("word"))
    counted = words.groupBy(_slot(F.xxhash64("word")).alias("slot")).count()
    out = [0] * SLOTS
    for row in counted.collect():  # SLOTS rows at most
        out[row["slot"]] = int(4 * math.log2(row["count"] + 1)) << 24
    return out


def _keys(classes: Column, starts: Column) -> Column:
    """32 bits for each word; rarer words have smaller keys."""
    hashed = F.transform(starts, lambda w: F.xxhash64(w))
    return F.transform(hashed, lambda h: F.get(classes, _slot(h).cast("int")).bitwiseOR(F.shiftrightunsigned(h, 40)))


def _token(key: Column, w: str, start: Column, words: int) -> Column:
    return F.shiftleft(key, 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.slice(w, start, words)), 32))


def _starts(w: str, words: int) -> Column:
    return F.slice(w, F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))


def _need(n: Column, threshold: float) -> Column:
    return F.ceil(F.lit(threshold) * n - F.lit(1e-9))


def prefixes(docs: DataFrame, classes: Column, words: int, threshold: float) -> DataFrame:
    """(doc_id, line, t1, t2, prefix): two hashes of the text and the tokens in the prefix
    of every line."""
    twice = F.xxhash64(F.reverse("text"))
    each = lines(docs).select("doc_id", "line", F.xxhash64("text").alias("t1"), twice.alias("t2"), split(F.col("text")).alias("w"))
    keyed = each.withColumn("keys", _keys(classes, _starts("w", words)))
    # distinct first words are distinct tokens, so the cut leaves tokens enough
    length = (F.size("keys") - _need(F.size("keys"), threshold) + 1).cast("int")
    cut = F.coalesce(F.get(F.sort_array(F.array_distinct("keys")), length - 1), F.lit(1 << 40))
    # bound, or the optimizer would sort the keys again for each of them
    chosen = bind(cut, lambda c: F.transform("keys", lambda k, i: F.when(k <= c, _token(k, "w", i + 1, words))))
    return keyed.select("doc_id", "line", "t1", "t2", F.array_distinct(F.array_compact(chosen)).alias("prefix"))


def token_sets(docs: DataFrame, wanted: DataFrame, classes: Column, words: int) -> DataFrame:
    """(doc_id, line, tokens): all tokens of the wanted lines, rarest first."""
    per = materialize(wanted.groupBy("doc_id").agg(F.collect_set("line").alias("wanted")))
    some = common.documents(docs).join(common.checked(per), "doc_id")
    each = some.select("doc_id", "wanted", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(
        F.array_contains("wanted", F.col("line"))).select("doc_id", "line", split(F.col("text")).alias("w"))
    tokens = F.transform(_keys(classes, _starts("w", words)), lambda k, i: _token(k, "w", i + 1, words))
    return each.select("doc_id", "line", F.sort_array(F.array_distinct(tokens)).alias("tokens"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, line) of the lines of `pairs` whose sets reach the threshold with that of
    (other_id, other_line)."""
    mine = sets.withColumnRenamed("tokens", "x")
    theirs = sets.select(F.col("doc_id").alias("other_id"), F.col("line").alias("other_line"), F.col("tokens").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    fits = shared >= _need(F.size("x") + F.size("y") - shared, threshold)
    return (
        pairs.select("doc_id", "line", "other_id", "other_line").distinct()
        .join(mine, ["doc_id", "line"]).join(theirs, ["other_id", "other_line"]).filter(fits).select("doc_id", "line").distinct()
    )


def _possible(threshold: float) -> Column:
    """Length filter; positional filter: the tokens before a shared one, itself, and the
    tokens after it bound what two lines of n and m tokens share; and bit maps, which
    bound from below how many tokens differ."""
    n, m, i, j = (F.col(c) for c in ("n", "m", "i", "j"))
    reach = F.least(i, j) + F.least(n - i, m - j)
    overlap = F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - F.lit(1e-9))
    # a token that one line has and the other lacks flips a bit of its map, so bits that
    # differ are tokens that differ
    differ = reduce(F.greatest, [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in (("b0", "d0"), ("b1", "d1"))])
    return (
        (F.least(n, m) >= _need(F.greatest(n, m), threshold)) & (reach >= overlap) & (n + m - differ >= 2 * overlap)
    )


def _parity(tokens: str, shift: int) -> Column:
    """64 bits: the parity of the number of tokens at each of six bits of their hash."""

    def bit(t: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(t, shift).bitwiseAND(F.lit(63)).cast("int"))

    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda acc, t: acc.bitwiseXOR(bit(t)))


def _within_reach(pairs: DataFrame, threshold: float) -> DataFrame:
    """Positional filter over all prefix tokens a pair shares, of which each has a row in
    `pairs`: prefixes hold every token up to their cut, so up to the last shared one the
    lines share no others, and after it no more than the shorter rest."""
    seen = pairs.groupBy("doc_id", "line", "other_id", "other_line").agg(
        F.count(F.lit(1)).alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"), F.max("n").alias("n"), F.max("m").alias("m"))
    overlap = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m")) - F.lit(1e-9))
    return seen.filter(F.col("shared") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= overlap)


def removed_lines(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line) of the lines that match an earlier one."""
    classes = F.from_json(F.lit(json.dumps(slot_classes(docs))), "array<bigint>")
    place = [F.col("doc_id"), F.col("line")]
    # lines with one text: the first is held, the others are settled and carry no token
    same = Window.partitionBy("t1", "t2").orderBy(*place)
    numbered = prefixes(docs, classes, words, threshold).withColumn("earliest", F.first(F.struct(*place)).over(same))
    numbered = numbered.withColumn("copy", F.expr("earliest.doc_id <> doc_id OR earliest.line <> line"))
    tokens = numbered.select("doc_id", "line", "copy", F.explode_outer(
        F.when(F.col("copy"), F.array(F.xxhash64("doc_id", "line"))).otherwise(F.col("prefix"))).alias("token"))
    by_token = Window.partitionBy("copy", "token").orderBy(*place)
    held = materialize(
        tokens.select(
            "doc_id", "line", "copy", "token",
            F.first(F.struct("doc_id", "line")).over(by_token).alias("first"),
            F.lead(F.lit(True), 1, False).over(by_token).alias("more"),
        ).filter("copy OR more OR first.doc_id <> doc_id OR first.line <> line")
    )
    copies = held.filter("copy").select("doc_id", "line")
    held = held.filter("NOT copy").select("doc_id", "line", "token", F.col("first.doc_id").alias("first_id"), F.col("first.line").alias("first_line"))
    sets = materialize(token_sets(docs, held.select("doc_id", "line"), classes, words))
    per_line = held.groupBy("doc_id", "line").agg(F.collect_set(F.struct("token", "first_id", "first_line")).alias("h"))
    # where each shared token stands in the whole set
    placed = materialize(
        per_line.join(sets, ["doc_id", "line"]).select(
            "doc_id", "line", F.size("tokens").alias("n"), _parity("tokens", 0).alias("b0"), _parity("tokens", 6).alias("b1"),
            F.explode(F.transform("h", lambda h: F.struct(
                h["token"].alias("token"), h["first_id"].alias("first_id"), h["first_line"].alias("first_line"),
                F.array_position("tokens", h["token"]).alias("i")))).alias("h"),
        ).select("doc_id", "line", "n", "b0", "b1", "h.*")
    )
    others = placed.select(
        "token", F.col("doc_id").alias("other_id"), F.col("line").alias("other_line"), F.col("n").alias("m"), F.col("i").alias("j"),
        F.col("b0").alias("d0"), F.col("b1").alias("d1"))
    later = "(other_id < doc_id OR (other_id = doc_id AND other_line < line))"

    # against the earliest line of its tokens that it shares most of them with
    firsts = others.join(placed.select("token", F.col("first_id").alias("other_id"), F.col("first_line").alias("other_line")).distinct(),
                         ["token", "other_id", "other_line"], "left_semi")
    early = placed.join(firsts, "token").filter(later).filter(_possible(threshold))
    counted = early.groupBy("doc_id", "line", "other_id", "other_line").agg(F.count(F.lit(1)).alias("shared"))
    best = counted.groupBy("doc_id", "line").agg(
        F.max_by(F.struct("other_id", "other_line"), F.struct("shared", F.bitwise_not("other_id"), F.bitwise_not("other_line"))).alias("b")
    ).select("doc_id", "line", "b.*")
    near = materialize(_verified(best, sets, threshold))
    # then against all earlier lines, for lines that have no match yet
    left = placed.join(near, ["doc_id", "line"], "left_anti")
    more = _within_reach(left.join(others, "token").filter(later).filter(_possible(threshold)), threshold)
    return copies.unionByName(near).unionByName(_verified(more, sets, threshold))


def per_document(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, removed): the numbers (from 0) of the lines that go, in order, of every
    document that loses some."""
    gone = removed_lines(docs, words, threshold)
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def remove_lines(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` without the lines that match an earlier one; n_chars, where
    there is one, is counted anew."""
    gone = per_document(docs, words, threshold).select(F.col("doc_id").alias("gone_id"), "removed")
    # one struct, so that no column of the input can clash with a name used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(common.checked(materialize(gone)), F.col("row.doc_id") == F.col("gone_id"), "left")
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    changed = {"text": left}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(left).cast(docs.schema["n_chars"].dataType)

    def column(name: str) -> Column:
        value = F.col("row")[name]
        return (F.when(F.col("removed").isNull(), value).otherwise(changed[name]) if name in changed else value).alias(name)

    return joined.select(*[column(c) for c in docs.columns])
