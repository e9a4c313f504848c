"""Anchors of queries: profiles, scores by field, and what they add to the rows found by the base score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchors as A
from ..operators import candidates as C
from ..operators import family as P
from ..sources import tables as T
from .find import _KIND, _NAME, _PATH, _SHAPES, _SUBTYPE, CUES, _list, candidates, queries


def _fields() -> tuple[dict[str, Column], dict[str, Column]]:
    """Fields of candidates: names of tests and kind as terms; path, title and body as texts."""
    subtype = F.col("subtype")
    names = F.when(subtype == "test_case", A.test_terms(F.col("title"))).otherwise(F.array().cast("array<string>"))
    fields = {"test_name": names, "role": F.concat(A.text_terms(F.col("kind")), A.text_terms(subtype))}
    return fields, {"path": A.path_texts(F.col("path")), "title": F.array("title"), "body": F.array("body")}


def _scores(spark: SparkSession, sf: str, most: int) -> DataFrame:
    """Candidates scored by field."""
    fields, texts = _fields()
    return A.scores(anchor_queries(spark, sf), candidates(spark, sf), "artifact_id", fields, "v1", texts, most)


def anchor_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The queries with three words of the item quoted."""
    q = queries(spark, sf)
    return q.select("query_id", F.concat_ws(" ", F.concat(F.lit('"'), F.array_join(F.slice(F.split("text", " "), 1, 3), " "), F.lit('"')), "text").alias("text"))


def anchor_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The anchors of each query with their kinds."""
    return A.query_anchors(anchor_queries(spark, sf)).select("query_id", F.col("ord").cast("long").alias("ord"), "term", "kind", "specific", "protocol")


def anchor_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates that the anchors of a query score best."""
    s = _scores(spark, sf, most=8)
    return C.top_rows(s.select("query_id", "artifact_id", "score", F.array_join("matches", "|").alias("matches"), F.array_join("fields", "|").alias("fields"), "strong"), "artifact_id", 8)


def anchor_reranked(spark: SparkSession, sf: str) -> DataFrame:
    """The admitted candidates of each query after anchors, with the rows that these add, spread over lead anchors."""
    fields, texts = _fields()
    return A.best_reranked(queries(spark, sf), anchor_queries(spark, sf), candidates(spark, sf), "artifact_id", fields, texts, "code_task_family_v2", 16)


QUERIES = {f.__name__: f for f in (anchor_profile, anchor_scores, anchor_reranked)}

_TOKEN = r"[\p{L}\p{Nd}_./\\\-]+"
_SEPARATED = r"[/\\_.\-]"
_NAMED = "regexp_replace(lower(trim({0})), '^[`''\"]+|[`''\"]+$', '', 'g')"
_PARTS = _NAME.format("y0")
_SHORT = f"CASE WHEN len({_PARTS}) > 0 THEN array_to_string({_PARTS}, '') ELSE {_NAMED.format('y0')} END"
_BARE = r"regexp_replace({}, '\.[^.]*$', '')"
_QUOTED = """regexp_extract_all(text, '(?s)"[^"]*"|''[^'']*''')"""


def _terms(c: str) -> str:
    return f"list_filter([{_NAMED.format(c)}] || flatten(list_transform(regexp_extract_all({c}, '{_TOKEN}'), lambda y0: [{_NAMED.format('y0')}] || {_PARTS} || [{_SHORT}])), lambda z: z <> '')"


_TITLE = _NAME.format("title")
_CUE = ", ".join(f"'{c}'" for c in CUES)
_IDENTIFIER = r"(strlen(y0) >= 8 AND ((regexp_matches(y0, '\p{Ll}') AND regexp_matches(y0, '\p{Lu}')) OR regexp_matches(y0, '\p{Nd}'))) OR (strlen(low) >= 9 AND regexp_matches(low, '^test[\p{L}\p{Nd}]*\p{L}[\p{L}\p{Nd}]*$'))"
_PROFILE = f"""aq AS (SELECT query_id, '"' || array_to_string(string_split(text, ' ')[1:3], ' ') || '" ' || text AS text FROM (SELECT item_id AS query_id, text || ' ' || [{_CUE}][item_id % {len(CUES)} + 1] AS text FROM benchmark)),
quoted AS (SELECT query_id, unnest({_QUOTED}) AS x, generate_subscripts({_QUOTED}, 1) AS i FROM aq), words AS (SELECT query_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS y0, generate_subscripts(regexp_extract_all(text, '{_TOKEN}'), 1) AS i FROM aq),
lowered AS (SELECT *, lower(y0) AS low, {_SHORT} AS short FROM words), kinds AS (SELECT *, low IN {_list(A.BROAD_WORDS)} AS broad, {_IDENTIFIER} AS ident FROM lowered),
two AS (SELECT query_id, i, CASE WHEN low IN {_list(A.TASK_WORDS)} THEN [] WHEN low IN {_list(A.ROLE_WORDS)} THEN [['role', low]] WHEN regexp_matches(y0, '{_SEPARATED}') THEN [['path', low], [CASE WHEN short <> low THEN 'compact' END, short]]
  WHEN ident THEN [['compact', short], [CASE WHEN strlen(low) >= 4 AND NOT broad THEN 'rare' END, low]] WHEN broad THEN [['role', low]] WHEN strlen(low) >= 4 THEN [['rare', low]] ELSE [] END AS a FROM kinds),
every AS (SELECT query_id, i - 1000000 AS o, 'phrase' AS kind, {_NAMED.format('trim(x[2:-2])')} AS term FROM quoted UNION ALL SELECT query_id, 2 * i + j, x[1], x[2] FROM (SELECT query_id, i, unnest(a) AS x, generate_subscripts(a, 1) AS j FROM two)),
once AS (SELECT query_id, kind, term, min(o) AS o FROM every WHERE term <> '' AND kind IS NOT NULL GROUP BY 1, 2, 3),
anchors AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS ord, term, kind, bool_or(kind <> 'role') OVER (PARTITION BY query_id) AS specific, bool_or(term IN {_list(A.PROTOCOL_WORDS)}) OVER (PARTITION BY query_id) AS protocol FROM once)"""
_SCORES = rf"""{_PROFILE}, {T.ARTIFACTS}, c0 AS (SELECT artifact_id, title, body, CAST(artifact_id AS VARCHAR) AS id, split_part(path, '/', 2) AS lang, CAST(substr(repo_id, 9) AS INT) % {len(_SHAPES)} AS shape FROM artifacts), c1 AS (SELECT artifact_id, title, body, {_PATH} AS path, {_KIND} AS kind, {_SUBTYPE} AS subtype FROM c0),
fl AS (SELECT artifact_id, 'path' AS field, {_terms('path')} || {_terms(_BARE.format("split_part(path, '/', -1)"))} || flatten(list_transform(string_split(path, '/'), lambda s: {_terms(_BARE.format('s'))})) AS t FROM c1 UNION ALL SELECT artifact_id, 'title', {_terms('title')} FROM c1
UNION ALL SELECT artifact_id, 'test_name', [array_to_string({_TITLE}, ''), regexp_replace(array_to_string({_TITLE}, ''), '^test(.)', '\1')] || {_TITLE} FROM c1 WHERE subtype = 'test_case' UNION ALL SELECT artifact_id, 'role', {_terms('kind')} || {_terms('subtype')} FROM c1 UNION ALL SELECT artifact_id, 'body', {_terms('body')} FROM c1),
p AS (SELECT artifact_id, field, term, count(*) AS n FROM (SELECT artifact_id, field, unnest(t) AS term FROM fl) WHERE term IN (SELECT term FROM anchors WHERE specific) GROUP BY 1, 2, 3),
v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(DISTINCT artifact_id))) + 1 AS idf FROM p WHERE field <> 'body' AND (strlen(term) >= 3 OR term IN {_list(A.ROLE_WORDS)}) AND term NOT IN {_list(A.TASK_WORDS)} GROUP BY 1),
tf AS (SELECT artifact_id, term, list(field) AS fs, CAST(sum(CASE WHEN contains(term, ' ') THEN n * CASE field WHEN 'path' THEN 4.5 WHEN 'title' THEN 4.0 WHEN 'test_name' THEN 5.0 WHEN 'body' THEN 0.45 ELSE 0 END
  ELSE CASE field WHEN 'path' THEN least(n, 2) * 4.5 WHEN 'title' THEN least(n, 2) * 4.0 WHEN 'test_name' THEN least(n, 2) * 5.0 WHEN 'role' THEN least(n, 2) * 1.2 ELSE least(n, 3) * 0.2 END END) AS DOUBLE) AS tf FROM p WHERE NOT contains(term, ' ') OR field <> 'role' GROUP BY 1, 2),
w AS (SELECT a.query_id, artifact_id, ord, term, kind, fs, coalesce(idf, 1) AS idf, idf IS NOT NULL AS known, tf * CASE kind WHEN 'compact' THEN 1.25 * greatest(coalesce(idf, 1) - 1, 1) * 1.8 ELSE greatest(coalesce(idf, 1) - 1, 0) * CASE kind WHEN 'role' THEN CASE WHEN term IN {_list(A.BROAD_WORDS)} THEN 0.08 ELSE 0.18 END WHEN 'path' THEN 1.35 WHEN 'phrase' THEN 1.4 ELSE 1.05 END END AS worth
  FROM anchors a JOIN tf USING (term) LEFT JOIN v USING (term) WHERE specific), w2 AS (SELECT *, coalesce(bool_or(kind <> 'role') OVER (PARTITION BY query_id, artifact_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS subject FROM w WHERE worth > 0),
s AS (SELECT query_id, artifact_id, round(sum(CASE WHEN kind = 'role' AND NOT subject THEN worth * 0.25 ELSE worth END), 6) AS score, list(term ORDER BY ord) AS ms, flatten(list(fs)) AS fields,
  bool_or(kind <> 'role' AND term NOT IN {_list(A.BROAD_WORDS)} AND NOT (known AND idf < 1.8 AND kind <> 'compact') AND list_has_any(fs, ['path', 'title', 'test_name'])) AS strong FROM w2 GROUP BY 1, 2)"""

SQL = {
    "anchor_profile": f"WITH {_PROFILE} SELECT query_id, ord, term, kind, specific, protocol FROM anchors",
    "anchor_scores": f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank FROM s)
SELECT query_id, artifact_id, score, array_to_string(list_filter(ms, lambda x, i: list_position(ms, x) = i), '|') AS matches, array_to_string(list_sort(list_distinct(fields)), '|') AS fields, strong, rank FROM r WHERE rank <= 8""",
}


# --- packs ------------------------------------------------------------------------------------------------------------


def _pack(spark: SparkSession, sf: str, by_rarity: bool) -> DataFrame:
    """The best sixteen candidates of each query by anchors, as a pack with families and scores."""
    s = _scores(spark, sf, most=16)
    best = C.top_rows(s.select("query_id", "artifact_id", "score"), "artifact_id", 16).drop("score")
    # sixteen rows a query, so no growing side
    pack = candidates(spark, sf).select("artifact_id", "path", "title", "subtype").join(F.broadcast(best), "artifact_id").withColumn("reasons", F.lit(""))
    return P.pack_rows(pack, anchor_queries(spark, sf), by_rarity)


def family_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Families and scores of the rows of packs, by the rarity of terms in their pack."""
    return _pack(spark, sf, True).select("query_id", "artifact_id", "class", "family", "score")


def family_primary(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows of each pack are primary."""
    return P.primary(_pack(spark, sf, False), "artifact_id").select("query_id", "artifact_id", "family", "score", "primary")


QUERIES |= {f.__name__: f for f in (family_scores, family_primary)}

_COMPACTED = r"regexp_replace(lower({}), '[^\p{{L}}\p{{Nd}}]+', '', 'g')"
_BARE_PATH, _FIELD = "regexp_extract(path, '^([^#]*)', 1)", r"regexp_split_to_array({}, '[_.\-]')"
_FIELDS_OF = f"list_filter({_FIELD.format('t')}, lambda y: y <> '')"
_FTERMS = rf"list_distinct(list_filter(flatten(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}_.\-]+'), lambda t: [{_COMPACTED.format('t')}] || CASE WHEN len({_FIELDS_OF}) > 1 THEN list_transform({_FIELDS_OF}, lambda y: {_COMPACTED.format('y')}) ELSE [] END)), lambda t: strlen(t) >= 3 AND t NOT IN {_list(P.STOP)}))"
_STEM = _COMPACTED.format(r"regexp_replace(regexp_replace(regexp_replace(split_part(bare, '/', -1), '\.[^.]*$', ''), '(?:[.](?:test|spec)|[_-]test)+$', ''), '^test_', '')")
_FOLDERS = f"list_filter(string_split(bare, '/')[1:-2], lambda d: d <> '' AND {_COMPACTED.format('d')} NOT IN {_list(P.TEST_FOLDERS)})"


def _worth(points: dict[str, float]) -> str:
    return f"CASE WHEN t = stem THEN {points['stem']} WHEN list_contains(tokens, t) THEN {points['token']} WHEN contains(cpath, t) THEN {points['path']} WHEN contains(ctitle, t) THEN {points['title']} ELSE 0.0 END"


_PACK = rf"""{_SCORES}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank FROM s),
pk AS (SELECT b.query_id, artifact_id, rank, path, {_BARE_PATH} AS bare, {_COMPACTED.format('path')} AS cpath, {_COMPACTED.format('title')} AS ctitle, subtype, {_FTERMS} AS terms FROM best b JOIN c1 USING (artifact_id) JOIN aq USING (query_id) WHERE rank <= 16),
pf AS (SELECT *, {_STEM} AS stem, array_to_string({_FOLDERS}[-3:], '/') AS parent0, flatten(list_transform(string_split(lower(path), '/'), lambda x: regexp_split_to_array(x, '[^\p{{L}}\p{{Nd}}]+'))) || list_transform(string_split(lower(path), '/'), lambda x: {_COMPACTED.format('x')}) AS tokens,
  CASE WHEN regexp_matches(lower(bare), '{P.TESTS}') OR subtype = 'test_case' THEN 'test' WHEN regexp_extract(lower(bare), '\.([^./]*)$', 1) IN {_list(P.SOURCES)} THEN 'source' ELSE 'other' END AS class FROM pk),
fam AS (SELECT *, lower(parent0) AS parent, CASE WHEN list_contains(terms, stem) THEN 'stem:' || stem WHEN parent0 = '' THEN class || ':' || CASE WHEN stem = '' THEN 'unknown' ELSE stem END WHEN stem = '' THEN lower(parent0) ELSE lower(parent0) || '/' || stem END AS family FROM pf)"""
_ROW_SCORE = f"round(coalesce((SELECT sum(CAST({_worth(P.POINTS)} AS DOUBLE)) FROM (SELECT unnest(terms) AS t)), 0) + greatest({P.RANK_POINTS} - rank * {P.RANK_STEP}, 0) + CASE WHEN class = 'test' THEN {P.TEST_POINTS} ELSE 0 END, 6)"
SQL |= {
    "family_scores": f"""WITH {_PACK}, e AS (SELECT *, {_worth(P.RARE_POINTS)} AS w FROM (SELECT *, unnest(terms) AS t FROM fam)), h AS (SELECT query_id, t, count(*) AS df FROM e WHERE w > 0 GROUP BY 1, 2), n AS (SELECT query_id, count(*) AS n FROM fam GROUP BY 1),
x AS (SELECT query_id, artifact_id, sum(CAST(w AS DOUBLE) * CASE WHEN df <= 1 THEN 2.4 WHEN df <= 2 THEN 2.0 WHEN df <= 4 THEN 1.6 WHEN df / n <= 0.35 THEN 1.25 WHEN df / n >= 0.7 THEN 0.45 ELSE 0.8 END) AS w FROM e JOIN h USING (query_id, t) JOIN n USING (query_id) GROUP BY 1, 2)
SELECT query_id, artifact_id, class, family, round(CAST(coalesce(w, 0) + greatest({P.RARE_RANK_POINTS} - rank * {P.RARE_RANK_STEP}, 0) + CASE WHEN class = 'test' THEN {P.RARE_TEST_POINTS} ELSE 0 END AS DOUBLE), 6) AS score FROM fam LEFT JOIN x USING (query_id, artifact_id)""",
    "family_primary": f"""WITH {_PACK}, e AS (SELECT query_id, artifact_id, sum(CAST({_worth(P.POINTS)} AS DOUBLE)) AS w FROM (SELECT *, unnest(terms) AS t FROM fam) GROUP BY 1, 2),
sc AS (SELECT fam.*, round(CAST(coalesce(w, 0) + greatest({P.RANK_POINTS} - rank * {P.RANK_STEP}, 0) + CASE WHEN class = 'test' THEN {P.TEST_POINTS} ELSE 0 END AS DOUBLE), 6) AS score FROM fam LEFT JOIN e USING (query_id, artifact_id)),
fb AS (SELECT *, max(score) OVER (PARTITION BY query_id, family) AS fbest, row_number() OVER (PARTITION BY query_id, family ORDER BY score DESC, rank, path, artifact_id) AS inf, row_number() OVER (PARTITION BY query_id, family, class ORDER BY score DESC, rank, path, artifact_id) AS inc,
  class IN ('source', 'test') AND NOT regexp_matches(lower(bare), '{P.WEAK}') AND (rank <= 2 OR score >= {P.SAFE_SCORE}) AS safe FROM sc),
fr AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY fbest DESC, family) AS fam_no, row_number() OVER (PARTITION BY query_id, safe ORDER BY rank, score DESC, path, artifact_id) AS safe_no FROM fb),
st AS (SELECT *, CASE WHEN safe AND safe_no <= {P.PROTECTED} THEN [0, safe_no, 0] WHEN fam_no <= {P.STRONG_FAMILIES} AND inc = 1 AND class IN ('source', 'test') THEN [1, fam_no, CASE class WHEN 'test' THEN 1 ELSE 0 END] WHEN score >= {P.LEAST_SCORE} THEN [2, fam_no, inf] ELSE [3, fam_no, inf] END AS place FROM fr),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM st) SELECT query_id, artifact_id, family, score, n <= CASE WHEN place[1] < 3 THEN {P.MOST_PROTECTED_MODE} ELSE {P.FLOOR} END AS "primary" FROM nn""",
}
