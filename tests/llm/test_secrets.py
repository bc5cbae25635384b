"""Spans against Python's regular expressions."""

import random
import re
import time

from spreadlake.llm import secrets

BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+"),
}


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def run(df):
    return [(r["doc_id"], [tuple(s) for s in r["strong"]], [tuple(s) for s in r["linked"]]) for r in secrets.scan(df).collect()]


def test_base_spans_equal_leftmost_matches(docs):
    rng = random.Random(2)
    bits = ["password", "TOKEN", "Secret", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef", "x.y", "AKIA", "AKIA" + "Z9" * 9, "0123456789abcdef" * 2,
            "\U0001f600", "é", "\n", "a" * 24, "ſecret=abcdefgh", "token=token:abcdefg"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(300)]
    got = {i: strong for i, strong, _ in run(docs(rows))}
    assert got == {i: base(t) for i, t in rows}


def test_weak_parts_need_their_complement(docs):
    key, url, access = "Ab3/" * 10, "https://store.example.org:8443", "AKIA" + "Q7" * 8
    rows = [
        (1, f"{key} and {url}"), (2, f"{access} {key}"), (3, f"{access} {url}"), (4, f"{access} {key} {url}"),
        (5, f"client_id: bob_1 {' ' * 300} token: abcdefgh"), (6, "client_id: bob_1 token: abcdefgh"), (7, f"{access}{' ' * 201}{key}"),
    ]
    got = {i: [s[3] for s in linked] for i, _, linked in run(docs(rows))}
    assert got == {1: [], 2: ["key"], 3: [], 4: ["key", "endpoint"], 5: [], 6: ["id"], 7: []}


def linked(text):
    """Every weak part against all others."""
    spans = {}
    for k in secrets.KINDS:
        found = re.finditer(k.pattern, text, re.A)
        spans[k.name] = [(m.start(), secrets.KINDS.index(k), m.end(), k.name) for m in found if k.least <= len(m[k.group]) <= k.most]
    near = lambda s, kinds: any(o[0] <= s[2] + secrets.SCOPE and o[2] >= s[0] - secrets.SCOPE for k in kinds for o in spans[k])
    return sorted(s for weak, groups in secrets.BESIDE.items() for s in spans[weak] if all(near(s, kinds) for kinds in groups))


def test_links_equal_all_pairs(docs):
    rng = random.Random(12)
    bits = ["client_id: bob_1 ", "login=ann ", "token: abcdefgh ", "Ab3/" * 10 + " ", "AKIA" + "Q7" * 8 + " ", "https://a.example.org:80 ", "a1" * 13 + " ", " " * 90, " " * 250]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(150)]
    got = {i: spans for i, _, spans in run(docs(rows))}
    want = {i: linked(t) for i, t in rows}
    assert got == want and 300 < sum(map(len, want.values()))


def test_a_megabyte_of_matches(docs):
    text = "token=abcdefgh " * 50_000 + "client_id: bob_1 " * 20_000
    begun = time.time()
    [(_, strong, weak)] = run(docs([(1, text)]))
    assert time.time() - begun < 60
    assert strong == [(15 * i, 0, 15 * i + 14, "assign") for i in range(50_000)]
    first = 750_000
    assert weak == [s for i in range(20_000) if (s := (first + 17 * i, 3, first + 17 * i + 16, "id"))[0] - secrets.SCOPE <= first - 1]


def test_odd_rows(docs, odd):
    got = run(docs(odd))
    assert len(got) == len(odd) - 1 and all(not strong and not linked for i, strong, linked in got)
    assert run(docs(odd).limit(0)) == []
    long = "x " * 50_000 + "token=abcdefgh " * 200
    assert len(run(docs([(1, long)]))[0][1]) == 200
