"""Shapes of physical plans, and the registry."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from spreadlake.checks import source_checks, views as v
from spreadlake.checks.money_checks import costed, opportunities
from spreadlake.functions.text import display_name, html_unescape
from spreadlake.operators import screen

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql_and_a_plain_name():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries)
    # queries of the optional operators are numbered; some have no SQL form
    own = {n for n in queries if not re.match(r"op\d+_|pipeline$", n)}
    assert own <= set(oracles) and len(own) > 150


@pytest.mark.parametrize("missing", [("spreadlake.llm", "corpus_pipeline"), ("public_tokenizers",)])
def test_the_library_does_not_need_the_optional_operators(missing):
    import subprocess
    import sys

    code = """if 1:
        import sys
        missing = {missing!r}
        class Missing:
            def find_spec(self, name, path=None, target=None):
                if name in missing:
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Missing())
        import __spark_entry__ as e
        assert len(e.queries()) > 150 and set(e.queries()) == set(e.oracle_sql())
    """
    code = code.replace("{missing!r}", repr(missing))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry_points.__file__.rpartition("/")[0], timeout=120)


def test_a_scan_reads_no_input_over_and_over(spark):
    """Lookups too large to broadcast are shuffled, and read once each."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
        text = plan(entry_points.queries()["scan_opportunities"](spark, SF))
        files = re.findall(r"Location: [^\n]*", text)
        assert files and max(files.count(f) for f in set(files)) <= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", [
    "opportunities", "resolve_cascade", "fuzzy_name_match", "size_variant_match", "gtin_crosscheck", "barcode_match", "best_upside",
    "alert_dedup", "preferred_sibling", "quote_asof", "rolling_24h", "listing_changes", "budget_cut",
])
def test_no_pairwise_joins(spark, name):
    text = plan(entry_points.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_rows_of_every_pair_stay_where_they_are_made(spark):
    """What has a row for each offer and variant is neither shuffled nor sorted, though the
    tables it is made from are too large for Spark to send one on its own."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name, keys in (("live_report", "variant_id"), ("live_report", "product_id"), ("alert_recheck", "product_id"), ("synthesised_sizes", "product_id")):
            text = plan(entry_points.queries()[name](spark, SF))
            assert re.search(rf"BroadcastHashJoin \[{keys}#", text) and not re.search(rf"SortMergeJoin \[({keys}|retailer)#", text), (name, keys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pages_of_a_small_file_are_read_by_all_tasks(spark):
    pages = source_checks.pages(spark, SF, "p_name")
    assert pages.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_a_second_pass_of_unescaping_holds_one_first_pass(spark):
    def searches(name):
        shown = spark.createDataFrame([("a",)], "c string").select(name.alias("n"))
        return shown._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(")

    assert 0 < searches(display_name(F.col("c"))) <= 2 * searches(html_unescape(F.col("c")))


def test_screen_reaches_the_scan(spark, tmp_path):
    v.offer(spark, SF).write.parquet(str(tmp_path / "l"))
    listing = spark.read.parquet(str(tmp_path / "l"))
    text = plan(screen.cheap_screen(listing, v.config().filters).select("retailer", "price"))
    pushed = re.search(r"PushedFilters: \[([^\]]*)", text).group(1)
    assert "EqualTo(in_stock,true)" in pushed and "IsNotNull(currency)" in pushed
    assert "name" not in re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)


def test_only_needed_columns_are_read(spark):
    text = plan(entry_points.queries()["quote_latest"](spark, SF))
    assert "props" not in re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)


def test_caps_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry_points.queries()["resolution_cap"](spark, SF))


def test_latest_quote_is_reduced_before_the_shuffle(spark):
    text = plan(entry_points.queries()["quote_latest"](spark, SF))
    assert text.count("partial_max_by") >= 1


def test_policy_is_broadcast(spark):
    assert "BroadcastHashJoin" in plan(costed(spark, SF))


def test_entry_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "gate_profit" in df.columns


def test_flagship_runs_without_python_workers(spark):
    assert "Python" not in plan(opportunities(spark, SF))
