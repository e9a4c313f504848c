"""Source files: test units, intent comments, manifest rows and search in them.

The SQL writes down what the text of each file holds, so it shares no pattern with the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code as C
from ..operators import search as S
from ..sources import tables as T
from .search import TOKENS, _post_sql

MOST = 10


def test_units(spark: SparkSession, sf: str) -> DataFrame:
    return C.test_units(T.code_files(spark, sf))


def intent_comments(spark: SparkSession, sf: str) -> DataFrame:
    return C.intent_comments(T.code_files(spark, sf))


def source_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """One row a file; lists joined by a bar."""
    m = C.manifest(T.code_files(spark, sf))
    return m.select("path", "language", *[F.array_join(c, "|").alias(c) for c in ("terms", "symbols", "tests", "imports")])


def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many files import, define or test each value: symbols, tests and imports as rows."""
    m = C.manifest(T.code_files(spark, sf))
    # the outer kind infers no filter, which would find the names beside the scan, before the files are dealt to tasks
    each = m.select("path", F.explode_outer(F.map_from_arrays(F.array(F.lit("symbol"), F.lit("test"), F.lit("import")), F.array("symbols", "tests", "imports"))).alias("kind", "found"))
    return each.select("path", "kind", F.explode_outer("found").alias("value")).where("value IS NOT NULL").groupBy("kind", "value").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


def manifest_search(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over manifest rows for the words of each part type: score, then path; the best of each query."""
    m = C.manifest(T.code_files(spark, sf)).select("path", F.concat_ws(" ", "path", "terms", "symbols", "tests", "imports").alias("indexed"))
    q = T.table(spark, sf, "part").select(F.col("p_name").alias("query_id")).distinct().select("query_id", F.explode(C.path_terms("query_id")).alias("term"))
    return S.bm25_best(m, "path", F.col("indexed"), q, MOST)


QUERIES = {f.__name__: f for f in (test_units, intent_comments, source_manifest, manifest_counts, manifest_search)}

_LISTS = f"""{T.CODE_FILES}, m AS (SELECT *,
  CASE language WHEN 'go' THEN ['TestUnit' || k, 'TestMore', 'helper'] WHEN 'python' THEN ['TestUnit' || k, 'test_first', 'test_' || k] ELSE ['y'] END AS symbols,
  CASE language WHEN 'go' THEN ['TestUnit' || k, 'TestMore'] WHEN 'python' THEN ['test_first', 'test_' || k] ELSE list_filter([kind, 'holds ' || name], lambda v: length(v) BETWEEN 3 AND 120) END AS tests,
  CASE language WHEN 'go' THEN ['lib/unit' || k] WHEN 'python' THEN ['src.unit' || k, 'os'] ELSE ['./lib/unit' || k, 'react', 'x'] END AS imports,
  list_sort(CASE language WHEN 'go' THEN ['pkg', 'unit' || k, 'test', 'go', 'unit' || k || '_test'] WHEN 'python' THEN ['tests', 'test', 'unit' || k, 'py', 'test_unit' || k] ELSE ['web', 'unit' || k, 'spec', 'js', 'unit' || k || '.spec'] END) AS terms FROM code_files)"""
SQL = {
    "test_units": f"""WITH {T.CODE_FILES}, u AS (SELECT path, language, unnest(CASE language
  WHEN 'go' THEN [{{'n': 'TestUnit' || k, 'p': '', 's': 7, 'e': 11}}, {{'n': 'TestMore', 'p': '', 's': 12, 'e': 14}}]
  WHEN 'python' THEN [{{'n': 'test_first', 'p': 'TestUnit' || k, 's': 6, 'e': 7}}, {{'n': 'test_' || k, 'p': 'TestUnit' || k, 's': 8, 'e': 10}}]
  ELSE [{{'n': 'holds ' || name, 'p': kind, 's': 5, 'e': 5}}, {{'n': 'more', 'p': kind, 's': 6, 'e': 8}}] END) AS u FROM code_files)
SELECT path, language, u.n AS name, u.p AS parent, CAST(u.s AS BIGINT) AS start_line, CAST(u.e AS BIGINT) AS end_line FROM u""",
    "intent_comments": f"""WITH {T.CODE_FILES}, c AS (SELECT path, language, unnest(CASE language
  WHEN 'go' THEN [{{'s': 5, 'e': 6, 'r': 'todo', 't': 'TODO handle ' || kind || chr(10) || 'and ' || name}}, {{'s': 9, 'e': 11, 'r': 'invariant', 't': pack || chr(10) || 'must never be empty'}}]
  WHEN 'python' THEN [{{'s': 3, 'e': 4, 'r': 'rationale', 't': 'because ' || name || chr(10) || 'x'}}]
  ELSE [{{'s': 3, 'e': 3, 'r': 'workaround', 't': 'for now ' || name}}] END) AS c FROM code_files)
SELECT path, language, CAST(c.s AS BIGINT) AS start_line, CAST(c.e AS BIGINT) AS end_line, c.r AS role, c.t AS text FROM c""",
    "source_manifest": f"WITH {_LISTS} SELECT path, language, array_to_string(terms, '|') AS terms, array_to_string(symbols, '|') AS symbols, array_to_string(tests, '|') AS tests, array_to_string(imports, '|') AS imports FROM m",
    "manifest_counts": f"""WITH {_LISTS}, e AS (SELECT path, 'symbol' AS kind, unnest(symbols) AS value FROM m UNION ALL SELECT path, 'test', unnest(tests) FROM m UNION ALL SELECT path, 'import', unnest(imports) FROM m)
SELECT kind, value, count(*) AS files, min(path) AS first_path FROM e GROUP BY ALL""",
    "manifest_search": f"""WITH {_LISTS}, d AS (SELECT path, concat_ws(' ', path, array_to_string(terms, ' '), array_to_string(symbols, ' '), array_to_string(tests, ' '), array_to_string(imports, ' ')) AS indexed FROM m),
{_post_sql('d', 'path', 'indexed')}, q AS (SELECT DISTINCT p_name AS query_id, unnest(list_append({TOKENS.format('p_name')}, lower(p_name))) AS term FROM part), want AS (SELECT query_id, path, term, tf FROM post JOIN q USING (term)), df AS (SELECT term, count(DISTINCT path) AS df FROM want GROUP BY 1),
ranked AS (SELECT query_id, path, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))), 6) AS score FROM want JOIN df USING (term) JOIN sizes USING (path), corpus GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM ranked) SELECT query_id, path, score, rank FROM r WHERE rank <= {MOST}""",
}
