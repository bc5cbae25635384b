"""The query of phrase collocations, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spreadlake.llm import collocations
from spreadlake.llm.common import table

SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i : i + size - 1])) AS g
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size),
f AS (SELECT lang, g, any_value(size) AS size, count(*) AS a FROM g GROUP BY lang, g HAVING count(*) >= 30),
cut AS (SELECT lang, g, size, a, unnest(range(1, size)) AS k FROM f WHERE size >= 2),
s AS (
  SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r,
    CAST((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS BIGINT) AS score
  FROM cut AS c JOIN f AS x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f AS y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM s) WHERE o = 1),
sub AS (SELECT lang, g, size, a, unnest(range(2, size)) AS m FROM f WHERE size >= 3),
part AS (SELECT lang, a, g, m, unnest(range(1, size - m + 2)) AS i FROM sub),
inside AS (SELECT lang, g[i : i + m - 1] AS g, max(a) AS a FROM part GROUP BY ALL),
kept AS (
  SELECT b.* FROM b LEFT JOIN inside AS e ON e.lang = b.lang AND e.g = b.g
  WHERE e.a IS NULL OR 100 * e.a::HUGEINT < 80 * b.a::HUGEINT),
r AS (
  SELECT kept.lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM kept JOIN n ON kept.lang = n.lang)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM r)
WHERE rank <= 2000
"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    found = collocations.best(table(spark, sf_dir, "documents"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
