"""Personal data in texts: fixed patterns, and a conditional random field for other forms.

Base spans are leftmost, non-overlapping matches of a pattern for each kind, of which those
that fail the kind's check are dropped. They always stand. The field (`crf`) adds spans for
what the patterns miss: telephone numbers without a plus, addresses written out as `name (at)
host dot org`, cards and network addresses with other marks between their digits. It is
trained, each time, from a small labelled table (`examples`, EXAMPLES rows made by rule from
the patterns of sentences below), and sees the shapes of tokens: runs of letters or of
digits, and single marks. A token farther than REACH tokens from any digit, at sign or
written-out at can only be outside; all others, in all texts, are decoded. A decoded span is
kept if it passes its kind's check and touches no base span.

Texts go through in slices; a text is tokenized in numpy, and Python looks at single tokens
only near a digit or an at sign.

Defined cases: null texts are empty and hold nothing; rows without a doc_id are left out;
repeated rows are returned as often as they come; positions count code points, an end is
exclusive; spans are sorted by start, then kind as in KINDS; a text of any length takes time
in proportion to it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from spreadlake.llm import common, crf

KINDS = ("email", "ip", "card", "phone")
EXAMPLES, SEED = 600, 12
REACH = 3
CUE_REACH = 5
# Tokens between a written-out at and its dot.
HOST_REACH = 5
SLICE_BYTES = 4 << 20

# -- base spans ---------------------------------------------------------------

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: within one, the rest is the same.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")

Span = tuple[int, int, int]  # start, rank of the kind, end


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(found: str) -> str:
    return "".join(DIGITS.findall(found))


def _byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern of addresses, each at sign looked at once: what stands before
    one is the run of local characters that ends there, as far as no match has taken it."""
    taken, at = 0, text.find("@")
    while at >= 0:
        host = HOST.match(text, at)
        if host:
            start = at
            while start > taken and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, host.end()
                taken = host.end()
        at = text.find("@", max(at + 1, taken))


def base_spans(text: str) -> list[Span]:
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(map(_byte_sized, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- shapes -------------------------------------------------------------------

# Fixed word lists: what a written-out at, dot or a cue for a kind looks like.
AT_WORDS = ("at", "arobase", "arroba")
DOT_WORDS = ("dot", "punkt", "point", "punto")
CUES = {
    "email": ("email", "mail", "courriel", "correo", "contact", "kontakt", "write"),
    "ip": ("ip", "host", "server", "node", "router", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "telephone", "telefon", "teléfono", "téléphone", "call", "fax", "mobile", "cell", "ring", "dial"),
}
MARKS = "@.-+()/:[]{}<>_,;#%\"'=*|&$!?\n"
LENGTHS = ("d1", "d2", "d3", "d4", "d5", "d6", "d7", "d8", "d9", "d12", "d20")
WORDS = ("at", "dot", *CUES, "w1", "w3", "w4", "W", "WW", "wW")
NAMES = ("none", *LENGTHS, *WORDS, *MARKS, "other")
SHAPE_ID = {n: i for i, n in enumerate(NAMES)}
CUE_OF = {w: k for k, ws in CUES.items() for w in ws}
N_SHAPES = 2 * len(NAMES)


def shape(token: str) -> int:
    """Length of digits, case and length of letters, marks by themselves, cue words."""
    if token[0] in "0123456789":
        n = len(token)
        return SHAPE_ID[f"d{n}" if n < 9 else "d9" if n < 12 else "d12" if n < 20 else "d20"]
    if not token[0].isalpha():
        return SHAPE_ID.get(token, SHAPE_ID["other"])
    low = token.lower()
    if low in AT_WORDS or low in DOT_WORDS:
        return SHAPE_ID["at" if low in AT_WORDS else "dot"]
    if low in CUE_OF:
        return SHAPE_ID[CUE_OF[low]]
    if token == low:
        return SHAPE_ID["w1" if len(token) == 1 else "w3" if len(token) < 4 else "w4"]
    return SHAPE_ID["WW" if token.isupper() else "W" if token[1:] == low[1:] else "wW"]


CUE_SHAPE = np.zeros(N_SHAPES, np.int64)
for _i, _k in enumerate(KINDS):
    CUE_SHAPE[[2 * SHAPE_ID[_k], 2 * SHAPE_ID[_k] + 1]] = 1 + _i

MARK, DIGIT, LETTER, BLANK = 0, 1, 2, 3


def _classes() -> np.ndarray:
    kind = np.full(256, MARK, np.uint8)
    kind[list(b"0123456789")] = DIGIT
    kind[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
    kind[0x80:] = LETTER
    kind[list(b" \t\r\x0b\x0c")] = BLANK
    return kind


CLASSES = _classes()


def _dilated(mask: np.ndarray, left: int, right: int) -> np.ndarray:
    """What lies up to `left` places before, or `right` places after, a marked one."""
    n = len(mask)
    total = np.concatenate([[0], np.cumsum(mask)])
    at = np.arange(n)
    return total[np.minimum(at + left + 1, n)] > total[np.maximum(at - right, 0)]


# Line feeds between two texts: more than any token sees of what is around it.
GAP = b"\n" * (2 * REACH + CUE_REACH)


class Tokens:
    """The tokens of some texts that may be inside a span, as runs, with their shapes."""

    def __init__(self, texts: list[bytes]):
        raw = GAP + GAP.join(texts) + GAP
        size = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(size + len(GAP)) - size  # where each text begins
        data = np.frombuffer(raw, np.uint8)
        kind = CLASSES[data]
        # letters and digits go on as runs, marks stand alone
        on = (kind[1:] == kind[:-1]) & ((kind[1:] == DIGIT) | (kind[1:] == LETTER))
        real = kind != BLANK
        self.start = np.flatnonzero(np.concatenate([[True], ~on]) & real)
        self.end = np.flatnonzero(np.concatenate([~on, [True]]) & real) + 1
        what = kind[self.start]
        core = (what == DIGIT) | (data[self.start] == 64) | self._written_out(raw, data, what)
        inside = _dilated(core, REACH, REACH)
        near = _dilated(inside, CUE_REACH, 2)
        glued = np.zeros(len(self.start), np.int64)
        glued[1:] = self.start[1:] == self.end[:-1]
        shapes = np.zeros(len(self.start) + 4, np.int64)
        known: dict[bytes, int] = {}
        at = np.flatnonzero(near)
        for i, s, e in zip(at.tolist(), self.start[at].tolist(), self.end[at].tolist()):
            token = raw[s:e]
            if token not in known:
                known[token] = 2 * shape(token.decode("utf-8", "replace"))
            shapes[i + 2] = known[token]
        shapes[2:-2] += np.where(near, glued, 0)
        self.spot = np.flatnonzero(inside)
        self.around = np.stack([shapes[self.spot + 2 + p] for p in crf.AROUND], axis=1)
        cues = CUE_SHAPE[shapes[2:-2]]
        never = -1 - CUE_REACH
        last = np.concatenate([[never], np.maximum.accumulate(np.where(cues > 0, np.arange(len(cues)), never))[:-1]])[self.spot]
        self.cue = np.where(self.spot - last <= CUE_REACH, cues[np.maximum(last, 0)], 0)
        run = np.cumsum(np.concatenate([[1], np.diff(self.spot) > 1])[:len(self.spot)]) - 1
        self.size = np.bincount(run) if len(run) else np.empty(0, np.int64)

    def _written_out(self, raw: bytes, data: np.ndarray, what: np.ndarray) -> np.ndarray:
        """Words for an at sign with a word for a dot, or a dot between letters, after them;
        and those dots."""
        size = self.end - self.start
        letters = (what == LETTER) & (size > 1)
        two = np.zeros(len(self.start), np.int64)
        two[letters] = (data[self.start[letters]] | 32).astype(np.int64) << 8 | (data[self.start[letters] + 1] | 32)

        def among(names: tuple[str, ...]) -> np.ndarray:
            found = np.zeros(len(self.start), bool)
            hits = np.flatnonzero(np.isin(two, [ord(n[0]) << 8 | ord(n[1]) for n in names]) & np.isin(size, [len(n) for n in names]))
            found[[i for i in hits.tolist() if raw[self.start[i]:self.end[i]].lower().decode("utf-8", "replace") in names]] = True
            return found

        dot = data[self.start] == 46
        dot[1:-1] &= (self.start[2:] == self.end[1:-1]) & (what[2:] == LETTER) & (self.start[1:-1] == self.end[:-2]) & (what[:-2] == LETTER)
        dot |= among(DOT_WORDS)
        at = among(AT_WORDS) & _dilated(dot, HOST_REACH, 0)
        return at | dot & _dilated(at | (data[self.start] == 64), 0, HOST_REACH)


def _spans_of(tokens: Tokens, labels: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start byte, rank, end byte, cue) of each decoded span."""
    out, open_ = [], None
    for i, label, cue in zip(tokens.spot.tolist(), labels.tolist(), tokens.cue.tolist()):
        if label and label % 2 == 0 and open_ is not None and open_[3] == i - 1:
            open_[2:4] = [int(tokens.end[i]), i]
            continue
        if open_ is not None:
            out.append(open_)
        open_ = [int(tokens.start[i]), (label - 1) // 2, int(tokens.end[i]), i, cue] if label % 2 else None
    if open_ is not None:
        out.append(open_)
    return [(s, k, e, cue) for s, k, e, _, cue in out]


_OPEN, _SHUT = r"[\[({<]\s?", r"\s?[\])}>]"
_AT = rf"(?:\s?@\s?|\s?{_OPEN}(?:@|at|arobase|arroba){_SHUT}\s?)"
_DOT = rf"(?:\.|\s\.\s|\s?{_OPEN}(?:\.|dot|punkt|point|punto){_SHUT}\s?|\s(?:dot|punkt|point|punto)\s)"
_NAME = r"[^\W_][\w.+%-]*"
# A bare word for the sign is only trusted beside the same language's word for a dot.
WRITTEN = re.compile(
    rf"(?i){_NAME}(?:{_AT}[\w-]+(?:{_DOT}[\w-]+)+|\sat\s[\w-]+(?:\sdot\s[\w-]+)+|\sarobase\s[\w-]+(?:(?:\spoint\s|\.)[\w-]+)+"
    rf"|\sarroba\s[\w-]+(?:(?:\spunto\s|\.)[\w-]+)+)")


def passes(rank: int, found: str, cue: int) -> bool:
    """Whether a decoded span can be what it was labelled as."""
    kind, digits = KINDS[rank], _digits(found)
    if kind == "email":
        return WRITTEN.fullmatch(found) is not None
    if kind == "ip":
        parts = DIGITS.findall(found)
        return len(parts) == 4 and all(map(_byte_sized, parts))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 or 7 <= len(digits) < 9 and cue > 0 and KINDS[cue - 1] == "phone"


def found_spans(model: crf.Model, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base, added) spans of each text; the runs of all texts are decoded together."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    tokens = Tokens(raws)
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in texts]
    if not len(tokens.spot):
        return out
    labels = crf.viterbi(model, crf.scores(model, tokens.around, tokens.cue), tokens.size)
    owner = np.searchsorted(tokens.first, tokens.start[tokens.spot], side="right") - 1
    for i in np.unique(owner).tolist():
        if i >= 0:
            out[i] = (base_spans(texts[i]), [])
    points, of = np.empty(0), -1
    for s, k, e, cue in _spans_of(tokens, labels):
        i = int(np.searchsorted(tokens.first, s, side="right")) - 1
        if i < 0 or e > tokens.first[i] + len(raws[i]):
            continue
        if i != of:
            points, of = np.concatenate([[0], np.cumsum((np.frombuffer(raws[i], np.uint8) & 0xC0) != 0x80)]), i
            starts = np.array([b[0] for b in out[i][0]] or [0])
            ends = np.maximum.accumulate(np.array([b[2] for b in out[i][0]] or [0]))
        s, e = int(points[s - tokens.first[i]]), int(points[e - tokens.first[i]])
        # base spans that begin before this one's end must have ended before it begins
        before = int(np.searchsorted(starts, e)) - 1
        if (before < 0 or ends[before] <= s) and passes(k, texts[i][s:e], cue):
            out[i][1].append((s, k, e))
    return out


# -- training -----------------------------------------------------------------

# Sentences of the labelled table; names in braces are filled in by rule.
SENTENCES = (
    "please call {phone} today", "Tel.: {phone}", "phone {phone} or {phone}", "fax: {phone}", "Telefon {phone}, Montag", "ring me on {phone}.",
    "my number is {phone}", "{phone}", "Téléphone : {phone}", "teléfono {phone}\n", "mobile={phone}", "reach us at {phone} any time",
    "write to {email}", "email: {email}", "contact {email} for more", "{email}", "send it to {email}, thanks", "courriel : {email}",
    "correo {email}.", "E-Mail an {email} oder {email}", "from {ip} to {ip}", "server {ip} is up", "ip {ip}", "login from {ip}:", "host={ip}",
    "card {card} expires soon", "Visa {card}", "paid with {card}.", "Karte: {card}", "carte {card}", "tarjeta {card}, gracias", "{card}",
    "{word} {word} {num} {word}", "version {version} of {word}", "in {year} and {year}", "on {date} at {time}", "{price} {word}", "see section {version}",
    "Copyright (c) {year} {word}", "License, Version {version}", "token = \"{hex}\"", "id {hex} {word}", "{num} {word} {num}", "page {num} of {num}",
    "{word} at {word} {word}. {word}", "meet at {time} at the {word}", "look at {word}, {word}", "{word} ({num}) {word}", "{num}. {word} {word}",
    "{num}, {num}, {num}, {num}", "{num}-{num}", "{range} {word}", "{thousand} people", "{word}.{num}@{word} {word}", "{word}/{num}/{word}",
    "| {num} | {word} | {num} |", "{word} {hex}", "{year}-{year}", "isbn {isbn}", "score {num}:{num}", "{num} + {num} = {num}", "order {order}",
)
SYLLABLES = ("an", "ber", "co", "der", "el", "for", "ing", "la", "men", "no", "os", "re", "st", "tion", "ver", "é")


class _Filler:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def number(self, low: int, high: int) -> str:
        return str(self.rng.randrange(low, high))

    def word(self) -> str:
        out = "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randrange(1, 5)))
        return out.capitalize() if self.rng.random() < 0.15 else out

    def phone(self) -> str:
        area, a, b = self.digits(3), self.digits(3), self.digits(4)
        return self.rng.choice((
            f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area} {a} {b}", f"{area}.{a}.{b}", f"0{area} {a}{b}", f"0{self.digits(2)}/{a}{b}",
            f"00{self.number(1, 99)} {area} {a} {b}", f"+{self.number(1, 99)} ({area}) {a}-{b}", f"{a}-{b}", f"0{self.digits(1)} {self.digits(2)} {self.digits(2)} {self.digits(2)} {self.digits(2)}"))

    def email(self) -> str:
        name, host = self.word(), self.word().lower()
        if self.rng.random() < 0.3:
            name += self.rng.choice("._-") + self.number(1, 999)
        end = self.rng.choice(("com", "org", "net", "de", "fr", "es"))
        bare = self.rng.choice(((" at ", " dot "), (" AT ", " DOT "), (" arobase ", " point "), (" arroba ", " punto "), (" arobase ", ".")))
        at, dot = self.rng.choice((
            ("@", "."), (" @ ", " . "), bare, bare, (self.rng.choice((" (at) ", " [at] ", "(at)", "[at]", "[AT]", " <at> ")), self.rng.choice((".", " dot ", " (dot) ", " [dot] ", "[dot]", "(punkt)", "[.]")))))
        return f"{name}{at}{host}{dot}{end}"

    def ip(self) -> str:
        return self.rng.choice((".", ".", " . ", "[.]", "(.)")).join(self.number(0, 256) for _ in range(4))

    def card(self) -> str:
        body = self.rng.choice("3456") + self.digits(self.rng.choice((11, 12, 14, 14, 14)))
        digits = next(body + d for d in "0123456789" if luhn(body + d))
        return self.rng.choice(("", "", " ", "-", ".", "/", "  ")).join(digits[i:i + 4] for i in range(0, len(digits), 4))

    def num(self) -> str:
        return self.number(0, 10 ** self.rng.randrange(1, 7))

    def version(self) -> str:
        return ".".join(self.number(0, 20) for _ in range(self.rng.choice((1, 2, 2, 3))))

    def year(self) -> str:
        return self.number(1900, 2030)

    def date(self) -> str:
        d, m = self.number(10, 29), self.number(10, 13)
        return self.rng.choice((f"{self.year()}-{m}-{d}", f"{d}.{m}.{self.year()}", f"{d}/{m}/{self.year()}", f"{m}/{d}/{self.digits(2)}"))

    def time(self) -> str:
        return f"{self.number(10, 24)}:{self.number(10, 60)}" + self.rng.choice(("", f":{self.number(10, 60)}"))

    def price(self) -> str:
        return self.rng.choice(("$", "", "€ ")) + self.num() + self.rng.choice(("", f".{self.digits(2)}", f",{self.digits(2)}"))

    def hex(self) -> str:
        return "".join(self.rng.choice("0123456789abcdef") for _ in range(self.rng.choice((8, 24, 32, 40))))

    def range(self) -> str:
        return f"{self.number(1, 500)}-{self.number(500, 999)}"

    def thousand(self) -> str:
        return self.rng.choice((" ", ",", ".")).join([self.number(1, 999), *(self.digits(3) for _ in range(self.rng.randrange(1, 4)))])

    def isbn(self) -> str:
        return f"978-{self.digits(1)}-{self.digits(4)}-{self.digits(4)}-{self.digits(1)}"

    def order(self) -> str:
        return self.digits(self.rng.randrange(6, 14))


def examples(spark: SparkSession, count: int = EXAMPLES) -> DataFrame:
    """The labelled table: (text, spans), spans as (start, rank, end)."""
    fill, rows = _Filler(SEED), []
    for i in range(count):
        text, spans = "", []
        for part in re.split(r"(\{\w+\})", SENTENCES[i % len(SENTENCES)]):
            name = part[1:-1] if part.startswith("{") else None
            value = getattr(fill, name)() if name else part
            if name in KINDS:
                spans.append((len(text), KINDS.index(name), len(text) + len(value)))
            text += value
        around = [" ".join(fill.word() for _ in range(fill.rng.randrange(0, 4))) for _ in range(2)]
        lead = around[0] + " " if around[0] else ""
        rows.append((lead + text + (" " + around[1] if around[1] else ""), [(s + len(lead), k, e + len(lead)) for s, k, e in spans]))
    return spark.createDataFrame(rows, "text string, spans array<struct<start:long,rank:int,end:long>>")


def trained(labelled: DataFrame, limit: int = EXAMPLES) -> crf.Model:
    """The field, from at most `limit` rows of a labelled table."""
    rows = []
    for row in labelled.limit(limit).collect():
        raw = row["text"].encode()
        tokens = Tokens([raw])
        labels = np.zeros(len(tokens.spot), np.int64)
        for span in row["spans"]:
            start, end = (len(row["text"][:span[x]].encode()) for x in ("start", "end"))
            at = tokens.start[tokens.spot] - tokens.first[0]
            own = np.flatnonzero((at >= start) & (at < end))
            labels[own] = 2 + 2 * span["rank"]
            labels[own[:1]] = 1 + 2 * span["rank"]
        cut = np.cumsum(tokens.size)[:-1]
        for a, c, y in zip(*(np.split(x, cut) for x in (tokens.around, tokens.cue, labels))):
            if len(y):
                rows.append((a, c, y))
    return crf.train(KINDS, N_SHAPES, 1 + len(KINDS), rows)


# -- over documents -----------------------------------------------------------

def _scanner(model):
    kind = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(kind)), ("added", pa.list_(kind))])

    def written(spans: list[Span]) -> list[dict]:
        return [{"start": s, "rank": k, "end": e} for s, k, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.tables_of(batches, limit=SLICE_BYTES):
            found = found_spans(model.value, pc.fill_null(batch.column("text"), "").to_pylist())
            yield common.rows(schema, batch.column("doc_id"), [written(b) for b, _ in found], [written(a) for _, a in found])

    return run


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, base, added): arrays of spans (start, rank, end) of every document."""
    docs = common.documents(docs)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trained(examples(spark) if labelled is None else labelled))
    spans = "array<struct<start:long,rank:int,end:long>>"
    return docs.mapInArrow(_scanner(model), f"doc_id long, base {spans}, added {spans}")
