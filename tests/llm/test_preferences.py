"""Common prefixes, completions and masks."""

from spreadlake.llm import preferences as P

SCHEMA = "pair_id long, turn long, role string, text string"


def rows(spark, pair, *turns):
    return [(pair, i, r, t) for i, (r, t) in enumerate(turns)]


def run(spark, chosen, rejected):
    made = P.format_pairs(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA))
    return {r["pair_id"]: r for r in made.collect()}


def test_prefix_completions_and_masks(ready):
    shared = [("system", "be kind"), ("user", "hi \U0001f600")]
    got = run(ready, rows(ready, 1, *shared, ("assistant", "hé"), ("user", "more"), ("assistant", "b")),
              rows(ready, 1, *shared, ("assistant", "no")))[1]
    assert got["n_common"] == 2
    assert got["prompt"] == "<|system|>\nbe kind<|end|>\n<|user|>\nhi \U0001f600<|end|>\n"
    assert got["chosen"] == "<|assistant|>\nhé<|end|>\n<|user|>\nmore<|end|>\n<|assistant|>\nb<|end|>\n"
    assert [got["chosen"][s["start"]:s["end"]] for s in got["chosen_spans"]] == ["hé<|end|>", "b<|end|>"]
    assert [got["rejected"][s["start"]:s["end"]] for s in got["rejected_spans"]] == ["no<|end|>"]


def test_equal_and_contained_conversations_keep_a_turn(ready):
    a, b, c = ("user", "q"), ("assistant", "x"), ("user", "y")
    got = run(ready, rows(ready, 1, a, b) + rows(ready, 2, a, b, c), rows(ready, 1, a, b) + rows(ready, 2, a, b))
    assert got[1]["n_common"] == 1 and got[1]["chosen"] == got[1]["rejected"] == "<|assistant|>\nx<|end|>\n"
    assert got[2]["n_common"] == 1 and got[2]["rejected"] == "<|assistant|>\nx<|end|>\n"


def test_odd_rows(ready):
    chosen = [(1, 0, None, None), (1, 0, None, None), (2, None, "user", "lost"), (None, 0, "user", "lost"), (3, 0, "assistant", "")]
    got = run(ready, chosen, [(4, 0, "user", "z" * 100_000)])
    assert set(got) == {1, 3, 4}
    assert got[1]["chosen"] == "<||>\n<|end|>\n" and got[1]["rejected"] is None and got[1]["n_common"] == 0
    assert got[4]["chosen"] is None and len(got[4]["rejected"]) == 100_000 + 17
    assert run(ready, [], []) == {}


def test_pairs_share_their_opening(ready):
    table = [(c, 0, "user", "hot" if c % 3 else f"own {c}") for c in range(1, 30)] + [(c, 1, "assistant", f"a{c}") for c in range(1, 30)]
    df = ready.createDataFrame(table, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in P.format_pairs(*P.paired_by_opening(df)).collect()}
    hot = [c for c in range(1, 30) if c % 3]
    assert sorted(got) == sorted([c for c in range(1, 30) if c % 3 == 0] + hot[::2])
    for first, second in zip(hot[::2], hot[1::2]):
        assert got[first]["n_common"] == 1 and f"a{first}<" in got[first]["chosen"] and f"a{second}<" in got[first]["rejected"]
