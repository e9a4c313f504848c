"""Caps, quotas, recall of sets, identities of paths, labels and buckets, point updates, links as maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import selection as S
from ..operators.evaluation import timing_stats
from ..sources import tables as T
from .graph import _MENTIONS, _PAIRS, _mentions, shared_concept_pairs


def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = shared_concept_pairs(spark, sf)
    return p.select("src", "dst", F.round(S.pair_score(F.col("strong"), F.col("semantic"), F.col("idf_sum")), 6).alias("score"))


def mentions_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Title words as mentions, longer ones first: eight an artifact, then the rest up to the cap of the repository."""
    repo = T.artifacts(spark, sf).select(F.col("artifact_id").alias("doc"), "repo_id")
    m = _mentions(spark, sf).select("doc", "concept").distinct().join(repo, "doc").withColumn("weight", F.octet_length("concept"))
    kept = S.two_tier(m, "repo_id", "doc", [F.desc("weight"), F.col("concept"), F.col("doc")])
    return kept.select("repo_id", "doc", "concept")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(paths.is_test("path"), "test").when(F.col("path").startswith("vendor/"), "fixture").otherwise("implementation")
    return T.files(spark, sf).select("path", "size", role.alias("role"))


def source_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return S.quota_refill(_sources(spark, sf), "role", "path", [F.desc("size"), F.col("path")]).select("path", "role", "refill")


def bundle_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as bundles: all lines are expected; shipped ones are found, large ones with another role."""
    lines = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("bundle"), F.col("l_linenumber").alias("child"), F.col("l_returnflag").alias("role"), "l_linestatus", "l_quantity")
    found = lines.where("l_linestatus = 'F'").withColumn("role", F.when(F.col("l_quantity") > 45, "X").otherwise(F.col("role")))
    return S.set_recall(lines, found)


def identity_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieved todo lines against expected plans, every third of which names a line."""
    a = T.todos(spark, sf).select(F.concat(F.lit("plans/"), F.col("artifact_id").cast("string"), F.lit(".md#L"), F.col("ordinal").cast("string")).alias("path")).distinct()
    line = F.when(F.col("o_orderkey") % 3 == 0, "#l2").otherwise("")
    b = T.table(spark, sf, "orders").select(F.concat(F.lit("Plans\\"), F.col("o_orderkey").cast("string"), F.lit(".md"), line).alias("path"))
    return S.identity_matches(a, b)


def directory_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of artifacts and files by folder."""
    all_paths = T.artifacts(spark, sf).select("path").unionByName(T.files(spark, sf).select("path"))
    return all_paths.groupBy(S.directory_tag("path").alias("tag")).agg(F.count("*").alias("n"))


def section_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Kind and role of each heading line."""
    lines = T.markdown(spark, sf).select("artifact_id", F.explode(F.split("body", "\n")).alias("line")).where(F.col("line").rlike("^#+ "))
    heading = lines.select("artifact_id", F.regexp_replace("line", "^#+ ", "").alias("heading"))
    return heading.groupBy(S.heading_label(F.col("heading"), S.SECTION_KINDS).alias("kind"), S.heading_label(F.col("heading"), S.SECTION_ROLES).alias("role")).agg(F.count("*").alias("n"), F.min("heading").alias("example"))


def usage_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Users by the bucket of their events and of their longest one (value as seconds)."""
    u = T.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.floor(F.max("value") * 1000).alias("ms"))
    return u.groupBy(S.count_bucket(F.col("n")).alias("events"), S.duration_bucket(F.col("ms")).alias("longest")).agg(F.count("*").alias("users"))


def status_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Labels set the status of their documents: toxic ones are superseded, good ones accepted, others stay."""
    status = F.when(F.col("toxic") == 1, "superseded").when(F.col("quality") == 1, "accepted")
    new = T.table(spark, sf, "labels").select(F.col("doc_id").alias("artifact_id"), status.alias("status"))
    return S.point_updates(T.artifacts(spark, sf).select("artifact_id", "kind", "status"), new, "artifact_id", ["status"])


def links_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of each part by the kind of the line, as a map and as its entries."""
    kind = F.when(F.col("l_returnflag") == "R", "updated-by").otherwise("contains")
    links = T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), kind.alias("type"), F.concat(F.lit(" s"), F.col("l_suppkey").cast("string")).alias("target"))
    m = S.link_map(links, "src")
    return m.select("src", F.col("links")["link_contains"].alias("contains"), F.col("links")["link_updated_by"].alias("updated_by"))


def phase_timings(spark: SparkSession, sf: str) -> DataFrame:
    """Timings by phase and, where there is one, adapter; durations of 0 do not count."""
    adapter = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("adapter"), (F.col("user_id") % 10).cast("string")))
    e = T.table(spark, sf, "events").select(F.concat_ws(":", "event_type", adapter).alias("phase"), F.floor("value").alias("ms")).where("ms > 0")
    return timing_stats(e, "phase", "ms")


def fact_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Commits and changed files of each author, each table counted by itself."""
    c = T.commits(spark, sf)
    files = T.commit_files(spark, sf).groupBy("commit_id").agg(F.count("*").alias("files"))
    both = c.select("author", "commit_id").join(files, "commit_id", "left")
    return both.groupBy("author").agg(F.count("*").alias("commits"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


def path_histograms(spark: SparkSession, sf: str) -> DataFrame:
    root = F.get(F.split("path", "/"), F.lit(0))
    role = F.when(paths.is_test("path"), "test").when(paths.is_noise("path"), "ignored").otherwise("source")
    return S.histograms(T.files(spark, sf), {"language": paths.language("path"), "role": role, "root": root})


QUERIES = {f.__name__: f for f in (pair_scores, mentions_capped, source_quotas, bundle_recall, identity_joins, directory_tags, section_labels, usage_buckets, status_updates, links_by_type, phase_timings, fact_counts, path_histograms)}


def _label_sql(labels: Mapping[str, tuple[str, ...]]) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'''contains(h, '{w}')''' for w in some)} THEN '{label}'" for label, some in labels.items())
    return f"CASE {cases} ELSE '' END"


_NORM = "lower(trim(replace({0}, chr(92), '/')))"
_QUOTA = "CASE role " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in S.SOURCE_QUOTAS.items()) + " ELSE 0 END"
_GENERIC = ", ".join(f"'{g}'" for g in S.GENERIC_FOLDERS)
_RATIO = "round(CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0 END, 6)"
SQL = {
    "pair_scores": f"WITH {_PAIRS} SELECT src, dst, round(4.0::DOUBLE * strong + 1.0::DOUBLE * semantic + 0.2::DOUBLE * idf_sum, 6) AS score FROM pairs",
    "mentions_capped": f"""WITH {_MENTIONS}, m AS (SELECT DISTINCT repo_id, doc, concept FROM mentions JOIN artifacts ON doc = artifact_id),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, doc ORDER BY strlen(concept) DESC, concept) > {S.LEAST_MENTIONS} AS extra FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY extra, strlen(concept) DESC, concept, doc) AS place FROM r) SELECT repo_id, doc, concept FROM p WHERE place <= {S.MOST_MENTIONS}""",
    "source_quotas": f"""WITH {T.FILES}, f AS (SELECT path, size, CASE WHEN path LIKE '%\\_test.go' ESCAPE '\\' THEN 'test' WHEN starts_with(path, 'vendor/') THEN 'fixture' ELSE 'implementation' END AS role FROM files),
r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY size DESC, path) > {_QUOTA} AS refill FROM f), p AS (SELECT *, row_number() OVER (ORDER BY refill, size DESC, path) AS place FROM r) SELECT path, role, refill FROM p WHERE place <= {S.MOST_SOURCES}""",
    "bundle_recall": f"""WITH e AS (SELECT l_orderkey AS bundle, l_linenumber AS child, min(l_returnflag) AS want, min(CASE WHEN l_quantity > 45 THEN 'X' ELSE l_returnflag END) FILTER (WHERE l_linestatus = 'F') AS have FROM lineitem GROUP BY 1, 2),
b AS (SELECT bundle, count(want) AS want, count(have) AS have, count(*) FILTER (WHERE want = have) AS same FROM e GROUP BY 1),
n AS (SELECT count(*) AS expected_bundles, count(*) FILTER (WHERE have > 0) AS found_bundles, CAST(sum(want) AS BIGINT) AS expected_children, CAST(sum(have) AS BIGINT) AS found_children, sum(same) AS same FROM b)
SELECT expected_bundles, found_bundles, expected_children, found_children, {_RATIO.format("found_bundles", "expected_bundles")} AS bundle_recall, {_RATIO.format("same", "expected_children")} AS child_role_recall, {_RATIO.format("found_children", "found_bundles")} AS duplicate_pressure FROM n""",
    "identity_joins": f"""WITH {T.TODOS}, a AS (SELECT DISTINCT 'plans/' || artifact_id || '.md#L' || ordinal AS a FROM todos), b AS (SELECT 'Plans' || chr(92) || o_orderkey || '.md' || CASE WHEN o_orderkey % 3 = 0 THEN '#l2' ELSE '' END AS b FROM orders),
x AS (SELECT a, {_NORM.format("a")} AS an FROM a), y AS (SELECT b, {_NORM.format("b")} AS bn FROM b)
SELECT a, b FROM x JOIN y ON regexp_replace(an, '{S.LINES}', '') = regexp_replace(bn, '{S.LINES}', '') WHERE an = bn OR NOT (regexp_matches(an, '{S.LINES}') AND regexp_matches(bn, '{S.LINES}'))""",
    "directory_tags": f"""WITH {T.ARTIFACTS}, {T.FILES}, p AS (SELECT path FROM artifacts UNION ALL SELECT path FROM files), d AS (SELECT string_split(path, '/')[:-2] AS d FROM p)
SELECT coalesce(list_filter(d, lambda s: s NOT IN ('', '.', {_GENERIC}) AND NOT regexp_matches(s, '^[0-9]{{3}}-.'))[1], '') AS tag, count(*) AS n FROM d GROUP BY 1""",
    "section_labels": f"""WITH {T.MARKDOWN}, l AS (SELECT unnest(string_split(body, chr(10))) AS line FROM markdown), h AS (SELECT regexp_replace(line, '^#+ ', '') AS heading, lower(heading) AS h FROM l WHERE regexp_matches(line, '^#+ '))
SELECT {_label_sql(S.SECTION_KINDS)} AS kind, {_label_sql(S.SECTION_ROLES)} AS role, count(*) AS n, min(heading) AS example FROM h GROUP BY 1, 2""",
    "usage_buckets": """WITH u AS (SELECT count(*) AS n, CAST(floor(max(value) * 1000) AS BIGINT) AS ms FROM events GROUP BY user_id)
SELECT CASE WHEN n <= 0 THEN '0' WHEN n <= 10 THEN '1-10' WHEN n <= 50 THEN '11-50' WHEN n <= 100 THEN '51-100' WHEN n <= 500 THEN '101-500' ELSE '501+' END AS events,
  CASE WHEN ms < 100 THEN '<100ms' WHEN ms < 500 THEN '100-499ms' WHEN ms < 1000 THEN '500-999ms' WHEN ms < 5000 THEN '1-4s' WHEN ms < 30000 THEN '5-29s' WHEN ms < 120000 THEN '30-119s' ELSE (ms // 1000) || 's+' END AS longest, count(*) AS users FROM u GROUP BY 1, 2""",
    "status_updates": f"WITH {T.ARTIFACTS} SELECT artifact_id, kind, coalesce(CASE WHEN toxic = 1 THEN 'superseded' WHEN quality = 1 THEN 'accepted' END, status) AS status FROM artifacts LEFT JOIN labels ON artifact_id = doc_id",
    "phase_timings": """WITH e AS (SELECT event_type || CASE WHEN user_id % 2 = 0 THEN ':adapter' || (user_id % 10) ELSE '' END AS phase, CAST(floor(value) AS BIGINT) AS ms FROM events)
SELECT phase, CAST(sum(ms) AS BIGINT) AS total, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS most, count(*) AS n FROM e WHERE ms > 0 GROUP BY 1""",
    "fact_counts": f"""WITH {T.COMMITS}, {T.COMMIT_FILES}, a AS (SELECT author, count(*) AS commits FROM commits GROUP BY 1), b AS (SELECT author, count(*) AS files FROM commits JOIN commit_files USING (commit_id) GROUP BY 1)
SELECT author, commits, coalesce(files, 0) AS files FROM a LEFT JOIN b USING (author)""",
    "path_histograms": f"""WITH {T.FILES}, f AS (SELECT path, path LIKE '%\\_test.go' ESCAPE '\\' AS test FROM files),
d AS (SELECT 'language' AS dimension, CASE WHEN path LIKE '%.go' THEN 'go' ELSE 'other' END AS value FROM f UNION ALL SELECT 'role', CASE WHEN test THEN 'test' WHEN starts_with(path, 'vendor/') THEN 'ignored' ELSE 'source' END FROM f UNION ALL SELECT 'root', split_part(path, '/', 1) FROM f)
SELECT dimension, value, count(*) AS n FROM d GROUP BY ALL""",
    "links_by_type": """WITH l AS (SELECT DISTINCT l_partkey AS src, l_returnflag = 'R' AS updated, 's' || l_suppkey AS target FROM lineitem)
SELECT src, string_agg(target, chr(10) ORDER BY target) FILTER (WHERE NOT updated) AS contains, string_agg(target, chr(10) ORDER BY target) FILTER (WHERE updated) AS updated_by FROM l GROUP BY src""",
}
