"""Structure of repositories and texts: ignore stack, imports, separate areas, excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import tokens
from ..operators import areas as A
from ..operators import code as C
from ..operators import imports as I
from ..operators import symbols as S
from ..operators.excerpts import MOST, excerpt
from ..sources import ignore
from ..sources import tables as T
from .search import TOKENS

# Rule files at the top; folders with an even number of files have one of their own.
TOP = {".gitignore": "# built\nvendor/\n*_test.go\n", ".git/info/exclude": "!unit1?_test.go\n", ".aiignore": "/src/economy-*/**\n!/src/**/unit?7.go\n"}


def _rule_files(spark: SparkSession, sf: str) -> DataFrame:
    top = spark.createDataFrame([("repo", p, b) for p, b in TOP.items()], "repo string, path string, body string")
    folders = T.files(spark, sf).groupBy(paths.directory("path").alias("folder")).agg(F.count("*").alias("n")).where("n % 2 = 0")
    body = F.concat(F.lit("unit*"), (F.col("n") % 10).cast("string"), F.lit(".go\n\n!/unit1*.go\n"))
    return top.unionByName(folders.select(F.lit("repo").alias("repo"), F.concat("folder", F.lit("/.gitignore")).alias("path"), body.alias("body")))


def ignore_stack(spark: SparkSession, sf: str) -> DataFrame:
    """What the rule files of all folders above a file say about it, and the rule that decides."""
    files = T.files(spark, sf).select(F.lit("repo").alias("repo"), "path")
    return ignore.ignored(files, _rule_files(spark, sf)).drop("repo")


def _code_paths(spark: SparkSession, sf: str) -> DataFrame:
    """path: the code files and what some of their imports mean; every fourth module has a second file of its name."""
    c = T.parts(spark, sf).select(F.col("p_partkey").cast("string").alias("k"), "p_size")
    more = F.array(
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("lib/unit"), "k", F.lit(".go"))),
        F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("backend/src/unit"), "k", F.lit(".py"))),
        F.when(F.col("p_size") % 4 == 1, F.concat(F.lit("tools/src/unit"), "k", F.lit("/__init__.py"))),
        F.when(F.col("p_size") % 4 == 3, F.concat(F.lit("tools/src/unit"), "k", F.lit(".py"))),
        F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("web/lib/unit"), "k", F.lit("/index.js"))),
    )
    return T.code_files(spark, sf).select("path").union(c.select(F.explode(F.array_compact(more))))


def _specs(spark: SparkSession, sf: str) -> DataFrame:
    return T.code_files(spark, sf).select("path", F.explode(C.imports("body")).alias("spec"))


def import_edges(spark: SparkSession, sf: str) -> DataFrame:
    return I.resolved(_code_paths(spark, sf), _specs(spark, sf))


def import_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """Suffixes of up to five segments that mean one file."""
    return I.suffix_index(_code_paths(spark, sf))


def import_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Imports inside areas; a file's areas are its top folder and its unit's last digits."""
    p = _code_paths(spark, sf)
    of = F.array(F.element_at(F.split("path", "/"), 1), F.concat(F.lit("unit"), F.regexp_extract("path", r"unit\d*(\d)", 1)))
    return I.evidence(import_edges(spark, sf), p.select("path", F.explode(of).alias("area")))


def separate_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Areas of files (folders at each depth, brands, sizes) that overlap little, best score first."""
    f = T.files(spark, sf)
    area = F.concat(paths.ancestors("path"), F.array(F.concat(F.lit("brand:"), F.element_at(F.split("path", "/"), 3)), F.concat(F.lit("size:"), F.col("size").cast("string"))))
    members = f.select("path", F.explode(area).alias("area"), paths.is_test("path").alias("t"))
    areas = members.groupBy("area").agg(F.count("*").alias("files"), F.count_if("t").alias("tests"))
    score = F.least("files", F.lit(40)) * 0.25 + F.when((F.col("tests") > 0) & (F.col("files") > F.col("tests")), 5.0).otherwise(0.0)
    return A.separate(areas.withColumn("score", score), members.select("area", F.col("path").alias("item")), [-F.col("score")], 60)


def section_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """Excerpts of whole documents around the words of their first lines."""
    d = T.table(spark, sf, "documents")
    first = F.filter(tokens(F.element_at(F.split("text", "\n"), 1)), lambda t: F.length(t) >= 7)
    return d.select("doc_id", excerpt("text", first).alias("excerpt")).select("doc_id", F.length("excerpt").cast("long").alias("n"), F.md5("excerpt").alias("digest"))


QUERIES = {f.__name__: f for f in (ignore_stack, import_edges, import_suffixes, import_evidence, separate_areas, section_excerpts)}

_PATHS = f"""{T.CODE_FILES}, paths AS (SELECT path FROM code_files UNION ALL SELECT unnest(list_filter([CASE WHEN p_size % 2 = 0 THEN 'lib/unit' || p_partkey || '.go' END, CASE WHEN p_size % 2 = 1 THEN 'backend/src/unit' || p_partkey || '.py' END,
  CASE p_size % 4 WHEN 1 THEN 'tools/src/unit' || p_partkey || '/__init__.py' WHEN 3 THEN 'tools/src/unit' || p_partkey || '.py' END, CASE WHEN p_size % 5 > 0 THEN 'web/lib/unit' || p_partkey || '/index.js' END], lambda p: p IS NOT NULL)) FROM part)"""
_EDGES = f"""{_PATHS}, edges AS (SELECT path, 'lib/unit' || k AS spec, 'lib/unit' || k || '.go' AS target FROM code_files WHERE language = 'go' AND 'lib/unit' || k || '.go' IN (SELECT path FROM paths)
UNION ALL SELECT path, './lib/unit' || k, 'web/lib/unit' || k || '/index.js' FROM code_files WHERE language = 'javascript' AND 'web/lib/unit' || k || '/index.js' IN (SELECT path FROM paths)
UNION ALL SELECT c.path, 'src.unit' || k, min(p.path) FROM code_files c JOIN paths p ON p.path IN ('backend/src/unit' || k || '.py', 'tools/src/unit' || k || '.py') WHERE language = 'python' GROUP BY c.path, k HAVING count(*) = 1)"""
_TOP_SQL = r"CASE WHEN regexp_matches(path, '^src/.*[/]unit[^/]7[.]go$') THEN ['f', '!/src/**/unit?7.go'] WHEN regexp_matches(path, '^src/economy-[^/]*/') THEN ['t', '/src/economy-*/**'] WHEN regexp_matches(path, '/unit1[^/]_test[.]go$') THEN ['f', '!unit1?_test.go'] WHEN path LIKE '%\_test.go' ESCAPE '\' THEN ['t', '*_test.go'] WHEN starts_with(path, 'vendor/') THEN ['t', 'vendor/'] END"
_AREA_SQL = f"""{T.FILES}, seg AS (SELECT path, size, path LIKE '%\\_test.go' ESCAPE '\\' AS t, string_split(path, '/') AS p FROM files),
members AS (SELECT path, t, unnest([array_to_string(p[1:i], '/') FOR i IN range(1, len(p))] || ['brand:' || p[3], 'size:' || size]) AS area FROM seg),
areas AS (SELECT area, count(*) AS files, count(*) FILTER (WHERE t) AS tests, least(count(*), 40) * 0.25 + CASE WHEN count(*) FILTER (WHERE t) > 0 AND count(*) > count(*) FILTER (WHERE t) THEN 5.0 ELSE 0.0 END AS score FROM members GROUP BY area),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, area) AS i FROM areas),
c AS (SELECT b.i AS i, a.i AS j FROM members x JOIN members y USING (path) JOIN o a ON a.area = x.area JOIN o b ON b.area = y.area WHERE a.i < b.i GROUP BY a.i, b.i, a.files, b.files HAVING count(*) / least(a.files, b.files) >= {A.LEAST_OVERLAP}),
before AS (SELECT i, list(j) AS js FROM c GROUP BY i), step AS (SELECT o.i, coalesce(js, []) AS js FROM o LEFT JOIN before USING (i)),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS chosen UNION ALL SELECT s.i, CASE WHEN list_has_any(s.js, r.chosen) THEN r.chosen ELSE list_append(r.chosen, s.i) END FROM r JOIN step s ON s.i = r.i + 1 WHERE len(r.chosen) < 60)"""
_HIT = r"(len(list_filter(words, lambda w: contains(lower(line), w))) > 0 OR regexp_matches(lower(line), '^\s*[-*] \[[ x]\]'))"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SQL = {
    "ignore_stack": rf"""WITH {T.FILES}, d AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, split_part(path, '/', -1) AS base FROM files), n AS (SELECT folder, count(*) % 10 AS digit FROM d GROUP BY folder HAVING count(*) % 2 = 0),
x AS (SELECT path, CASE WHEN digit IS NOT NULL AND regexp_matches(base, '^unit1[^/]*[.]go$') THEN ['f', '!/unit1*.go'] WHEN digit IS NOT NULL AND regexp_matches(base, '^unit[^/]*' || digit || '[.]go$') THEN ['t', 'unit*' || digit || '.go'] ELSE {_TOP_SQL} END AS r FROM d LEFT JOIN n USING (folder))
SELECT path, coalesce(r[1] = 't', FALSE) AS ignored, r[2] AS rule FROM x""",
    "import_edges": f"WITH {_EDGES} SELECT path, spec, target FROM edges",
    "import_suffixes": rf"""WITH {_PATHS}, s AS (SELECT path, string_split(path, '/') AS p, string_split(regexp_replace(path, '\.[^./]*$', ''), '/') AS b FROM paths),
e AS (SELECT DISTINCT path, unnest([array_to_string(p[-i:], '/') FOR i IN range(1, least(len(p), 5) + 1)] || [array_to_string(b[-i:], '/') FOR i IN range(1, least(len(b), 5) + 1)]) AS suffix FROM s) SELECT suffix, min(path) AS path FROM e GROUP BY suffix HAVING count(DISTINCT path) = 1""",
    "import_evidence": rf"""WITH {_EDGES}, m AS (SELECT path, unnest([split_part(path, '/', 1), 'unit' || regexp_extract(path, 'unit\d*(\d)', 1)]) AS area FROM paths),
b AS (SELECT a.area, regexp_matches(e.path, '_test\.go$|\.spec\.js$|^tests/') AS t FROM edges e JOIN m a ON a.path = e.path JOIN m b ON b.path = e.target AND b.area = a.area)
SELECT area, count(*) AS imports, count(*) FILTER (WHERE t) AS test_imports, round(0.65::DOUBLE * least(count(*), 40) + 1.4::DOUBLE * least(count(*) FILTER (WHERE t), 16), 6) AS score FROM b GROUP BY area""",
    "separate_areas": f"WITH RECURSIVE {_AREA_SQL} SELECT area, files, tests, CAST(score AS DOUBLE) AS score FROM o WHERE list_contains((SELECT chosen FROM r ORDER BY r.i DESC LIMIT 1), o.i)",
    "section_excerpts": rf"""WITH d AS (SELECT doc_id, {_STRIP.format('text')} AS body, list_filter({TOKENS.format("split_part(text, chr(10), 1)")}, lambda t: length(t) >= 7) AS words FROM documents), l AS (SELECT doc_id, words, string_split(body, chr(10)) AS ls FROM d WHERE length(body) > {MOST}),
x AS (SELECT doc_id, words, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l), h AS (SELECT doc_id, i, line, {_HIT} AS hit FROM x),
n AS (SELECT *, hit OR coalesce(lag(hit) OVER w, FALSE) OR coalesce(lead(hit) OVER w, FALSE) AS near FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)), k AS (SELECT doc_id, i, line, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM n WHERE near),
g AS (SELECT doc_id, i, CASE WHEN i > last + 1 THEN '...' || chr(10) ELSE '' END || line || chr(10) AS piece FROM k), c AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM g),
j AS (SELECT doc_id, {_STRIP.format("string_agg(piece, '' ORDER BY i)")} AS out FROM c WHERE so_far < {MOST} GROUP BY doc_id),
r AS (SELECT d.doc_id, CASE WHEN length(body) <= {MOST} THEN body WHEN coalesce(out, '') = '' THEN {_STRIP.format(f'left(body, {MOST})')} || chr(10) || '...' WHEN length(out) > {MOST} THEN {_STRIP.format(f'left(out, {MOST})')} || chr(10) || '...' ELSE out END AS e FROM d LEFT JOIN j USING (doc_id))
SELECT doc_id, CAST(length(e) AS BIGINT) AS n, md5(e) AS digest FROM r""",
}


# --- symbols ----------------------------------------------------------------------------------------------------------


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    """ref, title, body: orders that name the symbols of the units in their lines."""
    lines = T.table(spark, sf, "lineitem")
    said = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "calls `TestUnit").otherwise("see test_"), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "`.").otherwise("."))
    return lines.groupBy(F.col("l_orderkey").cast("string").alias("ref")).agg(F.array_join(F.array_sort(F.collect_list(said)), "\n").alias("body")).withColumn("title", F.lit("TestMore of the order"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return C.manifest(T.code_files(spark, sf)).select(F.col("path").alias("source"), "path", "symbols")


def symbol_references(spark: SparkSession, sf: str) -> DataFrame:
    """All references of orders to the symbols of code files."""
    return S.references(_mentions(spark, sf), _sources(spark, sf))


def symbol_edges(spark: SparkSession, sf: str) -> DataFrame:
    """References within the caps per text and per source."""
    return S.reference_edges(_mentions(spark, sf), _sources(spark, sf), of_text=2, to_source=24)


QUERIES |= {f.__name__: f for f in (symbol_references, symbol_edges)}
SQL |= {
    "symbol_references": f"""WITH {T.CODE_FILES}, s AS (SELECT path, k, unnest(CASE language WHEN 'go' THEN ['TestUnit' || k] WHEN 'python' THEN ['TestUnit' || k, 'test_' || k] ELSE [] END) AS form FROM code_files),
d AS (SELECT DISTINCT path, replace(lower(form), '_', '') AS name FROM s), m AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS ref, CASE WHEN l_linenumber % 2 = 0 THEN 'TestUnit' ELSE 'test_' END || l_partkey AS form FROM lineitem)
SELECT ref, path AS source, name, min(form) AS form, path FROM m JOIN d ON name = replace(lower(form), '_', '') GROUP BY ref, path, name""",
}
