import pytest

from spreadlake.llm import common

# Names the operators use themselves, as columns of the input.
CLASHING = ("block", "anchor", "fp", "token", "w", "line", "n", "word", "part", "removed", "row", "root", "gone_id", "first")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def ready(spark):
    return common.prepared(spark)


@pytest.fixture(scope="session")
def docs(ready):
    """docs([(id, text), ...]): a table of documents with columns that could clash."""

    def make(rows, lang="en"):
        full = [(i, t, lang if len(r) < 3 else r[2], "s", None) for r in rows for i, t in [r[:2]]]
        out = ready.createDataFrame(full, DOCS).repartition(3)
        for name in CLASHING:
            out = out.selectExpr("*", f"'x' AS {name}")
        return out

    return make


ODD = [
    (None, "a text without an id that is long enough to hold some words"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"),
    (6, "two words"), (7, "x " * 3000), (8, "y" * 20_000), (9, "éü \U0001f600 漢字\nnext line\r\nlast"), (10, "0 1 2 3 !!! ..."),
    (11, "same row again and again"), (11, "same row again and again"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
