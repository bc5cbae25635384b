"""Queries over the driver tables, one per operator, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spreadlake.llm import byteppm, collocation_queries, decontaminate, langid, linededup, manifest_queries, packing, personal_queries, preferences, secrets, simhash, substring, topk
from spreadlake.llm.common import crc_of_id, documents, prepared, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
win AS (
  SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM t WHERE len(w) >= 20)),
rep AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM rep),
per AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, len(w) AS n, coalesce(len(g), 0) AS r,
    list_filter(list_transform(range(len(w)), lambda i: CASE WHEN g IS NOT NULL AND list_contains(g, i) THEN NULL ELSE w[i + 1] END),
                lambda x: x IS NOT NULL) AS k
  FROM t LEFT JOIN per ON t.doc_id = per.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed,
  sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


@query("op2_substring_dedup", OP2_SQL)
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document after repeated windows of 20 words are removed."""
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op10_simhash_components")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_language_id")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    held_out = F.pmod(crc_of_id(), F.lit(3)) == 1
    found = langid.predict(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_best_fit_packing")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_ppm_score")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and PPM log10 probability of every document, learned from those not held out."""
    held_out = F.pmod(crc_of_id(), F.lit(5)) == 1
    scored = byteppm.scored(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, unnest(range(len(e))) AS i, unnest(e) AS x FROM v),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


@query("op1_top_k", OP1_SQL)
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the highest inner product for every twentieth vector."""
    vectors = (
        table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & topk.usable(F.col("embedding")))
        .select(F.col("vec_id").cast("long").alias("id"), topk.integer_weights(F.col("embedding")).alias("weights"))
    )
    return topk.top_k(vectors, vectors.filter(F.pmod("id", F.lit(20)) == 0), 20)


@query("op8_benchmark_leaks")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, replaced words allowed."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE doc_id IS NOT NULL AND text <> '')),
w AS (
  SELECT doc_id, line, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
s AS (
  SELECT doc_id, line, list_distinct(list_transform(range(greatest(len(w) - 4, 1)),
    lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS k FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, line, len(k) AS n, unnest(k) AS k FROM s),
p AS (
  SELECT y.doc_id, y.line, x.doc_id AS xd, x.line AS xl, any_value(y.n) AS n, any_value(x.n) AS m, count(*) AS c
  FROM e AS y JOIN e AS x ON y.k = x.k AND (x.doc_id < y.doc_id OR (x.doc_id = y.doc_id AND x.line < y.line))
  GROUP BY ALL),
g AS (SELECT DISTINCT doc_id, line FROM p WHERE c >= ceil(0.8 * (n + m - c) - 1e-9)),
r AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, coalesce(r.removed, '') AS removed
FROM documents AS d LEFT JOIN r ON d.doc_id = r.doc_id WHERE d.doc_id IS NOT NULL
"""


@query("op7_line_dedup", OP7_SQL)
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that match an earlier line."""
    docs = table(spark, sf_dir, "documents")
    gone = linededup.per_document(docs)
    count = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(F.split("text", "\n")))
    counted = documents(docs).select("doc_id", count.cast("long").alias("n_lines"))
    return counted.join(gone, "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"))


def _op5_sql() -> str:
    """Each kind's matches and what lies between them, as lists; positions add both up."""
    kinds = []
    for rank, k in enumerate(secrets.KINDS):
        pattern = k.pattern.replace("'", "''")
        kinds.append(f"""
  SELECT doc_id, '{k.name}' AS kind, {rank} AS rank, regexp_extract_all(t, '{pattern}', {k.group}) AS c,
    regexp_extract_all(t, '{pattern}', 0) AS m, string_split_regex(t, '{pattern}') AS p,
    {k.least} AS least, {k.most} AS most FROM t""")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
f AS ({' UNION ALL '.join(kinds)}),
g AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
h AS (
  SELECT doc_id, kind, rank, length(m[i]) AS n, length(c[i]) AS size, least, most,
    CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) AS BIGINT)
      + CAST(coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM g),
a AS (SELECT doc_id, kind, rank, s, s + n AS e FROM h WHERE size BETWEEN least AND most),
b AS (
  SELECT a.*, coalesce(bool_or(o.kind IN ('access', 'id')), false) AS ids,
    coalesce(bool_or(o.kind IN ('assign', 'hex', 'key')), false) AS secrets
  FROM a LEFT JOIN a AS o ON a.doc_id = o.doc_id AND o.s <= a.e + {secrets.SCOPE} AND o.e >= a.s - {secrets.SCOPE}
  GROUP BY ALL),
k AS (
  SELECT *, kind || ':' || s || ':' || e AS w FROM b
  WHERE rank < 3 OR (kind = 'id' AND secrets) OR (kind = 'key' AND ids) OR (kind = 'endpoint' AND ids AND secrets)),
d AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, coalesce(string_agg(w, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base,
    string_agg(w, ',' ORDER BY s, rank) AS spans FROM k GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN d ON t.doc_id = d.doc_id
"""


@query("op5_secret_spans", _op5_sql())
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, and weak parts of credentials beside what completes them."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("strong", lambda s: s["kind"])
    count = [F.size(F.array_remove(F.transform(kinds, lambda x: x == F.lit(k)), False)).cast("long").alias(f"n_{k}")
             for k in secrets.STRONG]
    return found.select(
        "doc_id", *count, F.sha2(secrets.written(F.col("strong")).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.sort_array(F.concat("strong", "linked"))).alias("spans"))


def _turns_sql(column: str) -> str:
    """Rendered turns, and the spans of what assistants say."""
    return f"""array_to_string(list_transform({column}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '')"""


def _learned_sql(column: str) -> str:
    size = "length(x.role) + length(x.text) + 13"
    before = f"CAST(coalesce(list_sum(list_transform({column}[1:i-1], lambda x: {size})), 0) AS BIGINT)"
    return f"""array_to_string(list_transform(
      list_filter(range(1, len({column}) + 1), lambda i: {column}[i].role = 'assistant'),
      lambda i: ({before} + length({column}[i].role) + 5) || ':' || ({before} + length({column}[i].role) + length({column}[i].text) + 12)), ',')"""


OP3_SQL = f"""
WITH d AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
t AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS t FROM d GROUP BY conv_id),
n AS (
  SELECT conv_id, t, t[1].role AS r, t[1].text AS x,
    (row_number() OVER (PARTITION BY t[1].role, t[1].text ORDER BY conv_id) - 1) AS n FROM t),
p AS (
  SELECT a.conv_id AS pair_id, a.t AS a, b.t AS b FROM n AS a
  LEFT JOIN n AS b ON a.r = b.r AND a.x = b.x AND b.n = a.n + 1 WHERE a.n % 2 = 0),
c AS (
  SELECT *, CASE WHEN b IS NULL THEN 0 ELSE least(len(a) - 1, len(b) - 1,
    len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]))) END AS k FROM p),
s AS (SELECT pair_id, k, a[1:k] AS q, a[k+1:] AS a, b[k+1:] AS b FROM c)
SELECT pair_id, CAST(k AS BIGINT) AS n_common, {_turns_sql('q')} AS prompt, {_turns_sql('a')} AS chosen,
  {_learned_sql('a')} AS chosen_spans, {_turns_sql('b')} AS rejected, {_learned_sql('b')} AS rejected_spans FROM s
"""


@query("op3_preference_pairs", OP3_SQL)
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and masked completions of conversations paired by their opening."""
    pairs = preferences.format_pairs(*preferences.paired_by_opening(table(spark, sf_dir, "conversations")))

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(spans)

    return pairs.select("pair_id", "n_common", "prompt", "chosen", written("chosen_spans"), "rejected", written("rejected_spans"))


query("op11_merkle_manifest", manifest_queries.SQL)(manifest_queries.op11)
query("op13_collocations", collocation_queries.SQL)(collocation_queries.op13)
query("op12_personal_data")(personal_queries.op12)
