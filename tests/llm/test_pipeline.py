"""The pipeline stage by stage against plain readings of each, and as a whole."""

import random
import re

import corpus_pipeline as P
import pytest
from tests.llm import test_linededup, test_simhash
from tests.llm.test_decontaminate import brute as leaking

from spreadlake.llm import packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(ready, tmp_path_factory):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = line(25)
    shared = line(12)
    rows = []
    for i in range(80):
        text = "\n".join(line(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 4)))
        if i % 9 == 1:
            text = f"{text}\n{shared}"
        if i % 10 == 2:
            text += f" {passage}"
        rows.append([i, text])
    # all lines but the first word of each are another document's, so the fingerprint is close
    long = [line(200) for _ in range(3)]
    rows[3][1], rows[40][1] = "\n".join(long), " ".join(long)
    rows[41][1], rows[42][1], rows[43][1] = None, "", "12 34 !!"
    folder = tmp_path_factory.mktemp("tables")
    full = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in rows]
    ready.createDataFrame(full, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    ready.createDataFrame([(0, passage), (1, line(20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def read(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_each_stage_on_what_the_one_before_kept(ready, sf_dir):
    docs = ready.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    bench = [tuple(r) for r in ready.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = read(docs)
    for (name, stage), plain in zip(P.STAGES[:-1], (language, lines, near_duplicates, lambda r: benchmark(r, bench)), strict=True):
        docs = P.materialize(stage(ready, docs, sf_dir))
        want = plain(rows)
        assert docs.columns == columns and read(docs) == want, name
        assert len(want) < len(rows) or want != rows, f"{name} had nothing to do"
        rows = want
    packed = P.STAGES[-1][1](ready, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows}
    whole = P.run(ready, sf_dir).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))
    assert max(r["offset"] + r["length"] for r in whole) <= packing.SIZE


def language(rows):
    return [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]


def lines(rows):
    gone = test_linededup.brute(rows)
    return [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in rows]


def near_duplicates(rows):
    prints = {i: test_simhash.plain(t) for i, t in rows}
    roots = test_simhash.joined(test_simhash.close(prints), prints)
    return [(i, t) for i, t in rows if roots[i] == i]


def benchmark(rows, items):
    gone = {d for d, _ in leaking(rows, items)}
    return [(i, t) for i, t in rows if i not in gone]


def test_empty_documents(ready, sf_dir):
    docs = ready.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = P.materialize(stage(ready, docs, sf_dir))
        assert docs.collect() == []
        docs = ready.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
