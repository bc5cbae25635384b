"""The manifest's query, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spreadlake.llm import merkle
from spreadlake.llm.common import table

# CRC-32 bit by bit: each byte of the decimal id, then eight shifts with the polynomial.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda r, b: list_reduce(list_concat([xor(r, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"""


def _field(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(f if f != "text" else text) for f in merkle.FIELDS) + ")"


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor({_CRC}, 4294967295) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS found
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
low AS (
  SELECT tree, 0 AS level, i, leaf AS h, n FROM r
  UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, level, i // 3, n),
tops AS (
  SELECT tree, level AS height, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
upp AS (
  SELECT 0 AS level, i, h, n FROM tops
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM upp WHERE n > 1 GROUP BY level, i // 3, n),
nodes AS (
  SELECT tree, level, i, h FROM low WHERE n > 1
  UNION ALL
  SELECT t.tree, t.height + u.level, u.i, u.h FROM tops AS t, upp AS u WHERE u.n > 1),
spot AS (
  SELECT r.tree, r.i AS leaf_i, r.found, n.level, n.i, n.h,
    CASE WHEN n.level < t.height THEN r.i // CAST(3 ** n.level AS BIGINT) ELSE t.i // CAST(3 ** (n.level - t.height) AS BIGINT) END AS own
  FROM r JOIN tops AS t ON r.tree = t.tree JOIN nodes AS n ON n.tree = r.tree
    AND n.i // 3 = CASE WHEN n.level < t.height THEN r.i // CAST(3 ** (n.level + 1) AS BIGINT) ELSE t.i // CAST(3 ** (n.level - t.height + 1) AS BIGINT) END),
sides AS (
  SELECT tree, leaf_i, level, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS a,
    coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS b FROM spot GROUP BY tree, leaf_i, level),
paths AS (
  SELECT tree, leaf_i, list(a ORDER BY level) AS a, list(b ORDER BY level) AS b FROM sides GROUP BY tree, leaf_i),
fold AS (
  SELECT r.tree, r.i AS leaf_i, 0 AS level, r.found AS h, coalesce(p.a, []) AS a, coalesce(p.b, []) AS b
  FROM r LEFT JOIN paths AS p ON p.tree = r.tree AND p.leaf_i = r.i
  UNION ALL
  SELECT tree, leaf_i, level + 1, sha256(a[level + 1] || h || b[level + 1]), a, b FROM fold WHERE level < len(a)),
ends AS (SELECT tree, leaf_i, h, array_to_string(list_transform(range(1, len(a) + 1), lambda k: a[k] || b[k]), '') AS p FROM fold WHERE level = len(a))
SELECT r.doc_id, r.leaf, t.h AS subroot, (SELECT h FROM upp WHERE n = 1) AS root, sha256(e.p) AS proof_sha256,
  e.h AS folded_root, e.h = (SELECT h FROM upp WHERE n = 1) AS verified
FROM r JOIN tops AS t ON r.tree = t.tree JOIN ends AS e ON e.tree = r.tree AND e.leaf_i = r.i
"""


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that follows from it once line
    feeds are gone from every other text."""
    rows = merkle.manifest(table(spark, sf_dir, "documents"), found=merkle.leaf_without_line_feeds())
    ends = rows.withColumn("folded_root", merkle.folded(F.col("found"), F.col("sides")))
    return ends.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("sides")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
