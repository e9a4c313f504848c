"""Evidence graph: concepts, noise, shared-concept pairs, edges of several kinds, neighbours, greedy caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import tokens
from ..operators import graph as G
from ..operators.search import top_per
from ..sources import tables as T
from .search import TOKENS


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    """doc, concept, form: words of five bytes and more of the first lines of documents."""
    a = T.artifacts(spark, sf)
    raw = F.explode(F.filter(F.split("title", r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 5))
    return a.select(F.col("artifact_id").alias("doc"), raw.alias("form")).withColumn("concept", F.lower("form"))


_MENTIONS = rf"""{T.ARTIFACTS}, f AS (SELECT artifact_id AS doc, unnest(list_filter(regexp_split_to_array(title, '[^\p{{L}}\p{{N}}]+'), lambda t: strlen(t) >= 5)) AS form FROM artifacts), mentions AS (SELECT doc, form, lower(form) AS concept FROM f), nn AS (SELECT count(*) AS n FROM documents)"""
_STATS = f"{_MENTIONS}, stats AS (SELECT concept, df, strong, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM (SELECT concept, count(DISTINCT doc) AS df, bool_or(regexp_matches(form, '[0-9]|[a-z][A-Z]')) AS strong FROM mentions GROUP BY 1), nn)"


def _stats(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    m, n = _mentions(spark, sf), T.table(spark, sf, "documents").count()
    return m, G.concept_stats(m, n), n


def concept_idf(spark: SparkSession, sf: str) -> DataFrame:
    _, s, _ = _stats(spark, sf)
    return s.select("concept", "df", "idf", F.array_join("forms", ",").alias("forms"))


def concept_noise(spark: SparkSession, sf: str) -> DataFrame:
    _, s, n = _stats(spark, sf)
    return s.groupBy(G.noise_reason(F.col("df"), F.col("concept"), n, ("there", "which")).alias("reason")).agg(F.count("*").alias("n"), F.max("df").alias("most"))


def glossary(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts of two documents and more with their kinds of documents and up to four example paths."""
    m = _mentions(spark, sf).select("doc", "concept").distinct().join(T.artifacts(spark, sf).select(F.col("artifact_id").alias("doc"), "kind", "path"), "doc")
    first = top_per(m, "concept", [F.col("path")], 4, "r").groupBy("concept").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))
    n = m.groupBy("concept").agg(F.count("*").alias("df"), F.count_if(F.col("kind") == "plan").alias("plans"), F.count_if(F.col("kind") == "decision").alias("decisions")).where("df >= 2")
    return n.join(first, "concept")


def shared_concept_pairs(spark: SparkSession, sf: str) -> DataFrame:
    m, s, _ = _stats(spark, sf)
    return G.shared_pairs(m, s)


def shared_concept_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.edge_scores(shared_concept_pairs(spark, sf)).select("src", "dst", "weight", "confidence")


def layout_group_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one folder of two to eight members, in order, at most 24 pairs a folder."""
    f = T.files(spark, sf).select("path", paths.directory("path").alias("dir"))
    ok = f.groupBy("dir").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 8").select("dir")
    f = f.join(ok, "dir")
    pairs = f.alias("a").join(f.alias("b"), F.col("a.dir") == F.col("b.dir")).where("a.path < b.path").select(F.col("a.dir").alias("dir"), F.col("a.path").alias("src"), F.col("b.path").alias("dst"))
    return top_per(pairs, "dir", [F.col("src"), F.col("dst")], 24).select("dir", "src", "dst", "rank")


def path_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts with one first line, two to twelve of them, each with the next by id."""
    a = T.artifacts(spark, sf).select("artifact_id", "title")
    w = Window.partitionBy("title")
    a = a.withColumn("n", F.count("*").over(w)).withColumn("dst", F.lead("artifact_id").over(w.orderBy("artifact_id")))
    return a.where("n BETWEEN 2 AND 12 AND dst IS NOT NULL").select(F.col("artifact_id").alias("src"), "dst", "n")


def test_source_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Tests and sources by folder and stem (0.91) or by stem alone (0.86): the best signal of a pair, five a test."""
    f = T.files(spark, sf).select("path", paths.source_stem("path").alias("stem"), paths.directory("path").alias("dir"), paths.is_test("path").alias("is_test"))
    t, s = f.where("is_test").alias("t"), f.where("NOT is_test").alias("s")
    one = t.join(s, (F.col("t.stem") == F.col("s.stem")) & (F.col("t.dir") == F.col("s.dir"))).select(F.col("t.path").alias("src"), F.col("s.path").alias("dst"), F.lit(0.91).alias("w"))
    two = t.join(s, F.col("t.stem") == F.col("s.stem")).select(F.col("t.path").alias("src"), F.col("s.path").alias("dst"), F.lit(0.86).alias("w"))
    best = one.unionByName(two).groupBy("src", "dst").agg(F.max("w").alias("weight"))
    return top_per(best, "src", [F.desc("weight"), F.col("dst")], 5).select("src", "dst", "weight")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between nations' customers, of two types, with repeats: (src, dst, type, evidence, weight, confidence, explanation, seq)."""
    line = T.table(spark, sf, "lineitem")
    e = line.select(
        F.col("l_partkey").alias("src"),
        (F.col("l_suppkey") + 1_000_000).alias("dst"),
        F.when(F.col("l_returnflag") == "R", "reference").otherwise("shared").alias("type"),
        F.lit(1).cast("long").alias("evidence"),
        (F.col("l_quantity") / 50).alias("weight"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("explanation"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )
    return e


_EDGES = "edges AS (SELECT l_partkey AS src, l_suppkey + 1000000 AS dst, CASE l_returnflag WHEN 'R' THEN 'reference' ELSE 'shared' END AS type, l_quantity / 50 AS weight, 1 - l_discount AS confidence, l_orderkey || ':' || l_linenumber AS explanation, l_orderkey * 100 + l_linenumber AS seq FROM lineitem)"


def merged_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.merged_edges(_edges(spark, sf)).select("src", "dst", "type", "evidence", F.round("weight", 6).alias("weight"), F.round("confidence", 6).alias("confidence"), "explanation")


def edge_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by type, with the first two edges as examples."""
    m = G.merged_edges(_edges(spark, sf))
    first = top_per(m, "type", [F.col("src"), F.col("dst")], 2, "r").groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws("-", "src", "dst").alias("e")))), lambda s: s["e"]), ",").alias("examples"))
    return m.groupBy("type").agg(F.count("*").alias("n"), F.sum("evidence").alias("evidence")).join(first, "type")


def neighbour_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """One hop from the parts of one brand, at most three edges a seed and type."""
    seeds = T.table(spark, sf, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("seed_rank"))
    return G.neighbours(merged_edges(spark, sf), seeds, 3, 0.9)


def edges_degree_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy: the best edges of each type, at most 300 of a type and three at a node."""
    e = merged_edges(spark, sf).select("type", "src", "dst", F.col("weight").alias("score"))
    return G.degree_capped(e, "type", 300, 3)


def overlap_coefficient(spark: SparkSession, sf: str) -> DataFrame:
    """Word sets of neighbouring benchmark items: common words over the smaller set."""
    b = T.table(spark, sf, "benchmark").select("item_id", F.array_distinct(tokens("text")).alias("w"))
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    both = F.size(F.array_intersect("w", "v"))
    return b.join(n, "item_id").select("item_id", both.cast("long").alias("common"), F.round(both / F.least(F.size("w"), F.size("v")), 6).alias("overlap"), F.array_join(F.array_sort(F.array_except("w", "v")), " ").alias("missing"))


QUERIES = {f.__name__: f for f in (concept_idf, concept_noise, glossary, shared_concept_pairs, shared_concept_edges, layout_group_edges, path_edges, test_source_edges, merged_edges, edge_diagnostics, neighbour_expansion, edges_degree_capped, overlap_coefficient)}

_PAIRS = f"""{_STATS}, rr AS (SELECT DISTINCT doc, concept, idf, strong FROM mentions JOIN stats USING (concept) WHERE df BETWEEN 2 AND 6), pp AS (SELECT a.doc AS src, b.doc AS dst, concept, a.idf AS idf, a.strong AS strong FROM rr a JOIN rr b USING (concept) WHERE a.doc < b.doc),
pr AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY strong DESC, idf DESC, concept) AS r FROM pp),
pairs AS (SELECT src, dst, count(*) AS shared, count(*) FILTER (WHERE r <= 5 AND strong) AS strong, count(*) FILTER (WHERE r <= 5 AND NOT strong) AS semantic, round(sum(idf) FILTER (WHERE r <= 5), 6) AS idf_sum, max(idf) FILTER (WHERE r <= 5) AS idf_max, string_agg(concept, ',' ORDER BY r) FILTER (WHERE r <= 5) AS concepts FROM pr GROUP BY 1, 2)"""
_MERGED = f"{_EDGES}, merged AS (SELECT src, dst, type, count(*) AS evidence, round(max(weight), 6) AS weight, round(max(confidence), 6) AS confidence, min_by(explanation, seq) AS explanation FROM edges GROUP BY src, dst, type)"
_FILE = f"{T.FILES}, f AS (SELECT path, regexp_replace(lower(split_part(split_part(path, '/', -1), '.', 1)), '_test$', '') AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, path LIKE '%\\_test.go' ESCAPE '\\' AS is_test FROM files)"
SQL = {
    "concept_idf": f"WITH {_STATS}, u AS (SELECT concept, list_sort(list_distinct(list(form)))[1:6] AS forms FROM mentions GROUP BY 1) SELECT concept, df, idf, array_to_string(forms, ',') AS forms FROM stats JOIN u USING (concept)",
    "concept_noise": f"WITH {_STATS}, r AS (SELECT df, CASE WHEN df < 2 THEN 'single_artifact' WHEN df > 6 THEN 'too_many_artifacts' WHEN concept IN ('there', 'which') THEN 'stop_word' WHEN df / n > 0.35 AND n >= 10 THEN 'high_document_frequency' ELSE '' END AS reason FROM stats, nn) SELECT reason, count(*) AS n, max(df) AS most FROM r GROUP BY 1",
    "glossary": f"""WITH {_MENTIONS}, m AS (SELECT DISTINCT concept, doc, kind, path FROM mentions JOIN artifacts ON doc = artifact_id), r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY path) AS r FROM m)
SELECT concept, count(*) AS df, count(*) FILTER (WHERE kind = 'plan') AS plans, count(*) FILTER (WHERE kind = 'decision') AS decisions, string_agg(path, ',' ORDER BY path) FILTER (WHERE r <= 4) AS paths FROM r GROUP BY concept HAVING count(*) >= 2""",
    "shared_concept_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "shared_concept_edges": f"WITH {_PAIRS} SELECT src, dst, round(least(0.32::DOUBLE + 0.12::DOUBLE * strong + 0.06::DOUBLE * semantic + 0.04::DOUBLE * idf_max, 1.0), 3) AS weight, round(least(0.56::DOUBLE + 0.10::DOUBLE * strong + 0.04::DOUBLE * semantic + 0.03::DOUBLE * idf_max, CASE WHEN strong > 0 AND semantic > 0 THEN 1.0 ELSE 0.84 END), 3) AS confidence FROM pairs",
    "layout_group_edges": f"WITH {_FILE}, ok AS (SELECT dir FROM f GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8), p AS (SELECT dir, a.path AS src, b.path AS dst, row_number() OVER (PARTITION BY dir ORDER BY a.path, b.path) AS rank FROM f a JOIN f b USING (dir) JOIN ok USING (dir) WHERE a.path < b.path) SELECT * FROM p WHERE rank <= 24",
    "path_edges": f"WITH {T.ARTIFACTS}, w AS (SELECT artifact_id AS src, lead(artifact_id) OVER (PARTITION BY title ORDER BY artifact_id) AS dst, count(*) OVER (PARTITION BY title) AS n FROM artifacts) SELECT * FROM w WHERE n BETWEEN 2 AND 12 AND dst IS NOT NULL",
    "test_source_edges": f"WITH {_FILE}, p AS (SELECT t.path AS src, s.path AS dst, CAST(CASE WHEN t.dir = s.dir THEN 0.91 ELSE 0.86 END AS DOUBLE) AS weight FROM f t JOIN f s ON t.stem = s.stem AND t.is_test AND NOT s.is_test), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM p) SELECT src, dst, weight FROM r WHERE r <= 5",
    "merged_edges": f"WITH {_MERGED} SELECT * FROM merged",
    "edge_diagnostics": f"WITH {_MERGED}, r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY src, dst) AS r FROM merged) SELECT type, count(*) AS n, CAST(sum(evidence) AS BIGINT) AS evidence, string_agg(src || '-' || dst, ',' ORDER BY r) FILTER (WHERE r <= 2) AS examples FROM r GROUP BY type",
    "neighbour_expansion": f"""WITH {_MERGED}, seeds AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#11'), b AS (SELECT src AS node, dst AS other, type, weight, confidence FROM merged UNION ALL SELECT dst, src, type, weight, confidence FROM merged),
h AS (SELECT *, row_number() OVER (PARTITION BY node, type ORDER BY weight DESC, confidence DESC, other) AS r FROM b JOIN seeds USING (node) WHERE confidence >= 0.9), k AS (SELECT * FROM h WHERE r <= 3 AND other NOT IN (SELECT node FROM seeds)),
o AS (SELECT *, row_number() OVER (PARTITION BY other ORDER BY node, r, type) AS o FROM k) SELECT other AS node, node AS seed, type, weight FROM o WHERE o = 1""",
    "overlap_coefficient": f"""WITH b AS (SELECT item_id, list_distinct({TOKENS.format('text')}) AS w FROM benchmark), p AS (SELECT a.item_id, a.w, b.w AS v FROM b a JOIN b ON b.item_id = a.item_id + 1)
SELECT item_id, len(list_intersect(w, v)) AS common, round(len(list_intersect(w, v)) / least(len(w), len(v)), 6) AS overlap, array_to_string(list_sort(list_filter(w, lambda t: NOT list_contains(v, t))), ' ') AS missing FROM p""",
}
