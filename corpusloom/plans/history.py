"""Change history: commit filters, co-change, recency, work references, topics, boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import history as H
from ..operators.search import top_per
from ..sources import tables as T


def commit_size_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Commits by size class, and how many of their files large ones lose."""
    n = T.commit_files(spark, sf).groupBy("commit_id").agg(F.count_distinct("path").alias("n"))
    size = F.when(F.col("n") > H.MOST_FILES, "large").when(F.col("n") > 1, "medium").otherwise("small")
    return n.groupBy(size.alias("size")).agg(F.count("*").alias("commits"), F.sum(F.greatest(F.col("n") - H.MOST_FILES, F.lit(0).cast("long"))).alias("dropped"))


def history_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as repositories, their orders as commits; those with debts have an older history that is cut off."""
    repos = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("author"), (F.col("c_acctbal") < 0).alias("cut"))
    c = repos.join(T.commits(spark, sf).groupBy("author").agg(F.count("*").alias("commits")), "author", "left")
    return c.select("author", F.coalesce("commits", F.lit(0).cast("long")).alias("commits"), H.history_shape(F.coalesce("commits", F.lit(0)), F.col("cut")).alias("shape"))


def first_commit_dates(spark: SparkSession, sf: str) -> DataFrame:
    f = T.commit_files(spark, sf).where("change = 'A'")
    return f.join(T.commits(spark, sf), "commit_id").groupBy("path").agg(F.min("committed_at").alias("authored_at"))


def cochange_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return H.cochange_pairs(T.commit_files(spark, sf)).groupBy("left", "right").agg(F.count("*").alias("evidence")).where("evidence >= 2")


def cochange_scored(spark: SparkSession, sf: str) -> DataFrame:
    """The 250 best pairs with examples, weight and confidence."""
    t = H.cochange_totals(H.cochange_pairs(T.commit_files(spark, sf)), T.commits(spark, sf)).orderBy(F.desc("evidence"), F.desc("latest"), "left", "right").limit(250)
    n = T.commit_files(spark, sf).groupBy("path").agg(F.count("*").alias("n"))
    side = lambda name: n.select(F.col("path").alias(name), (F.col("n") > H.DENSE).alias(f"{name}_dense"))
    t = t.join(side("left"), "left").join(side("right"), "right")
    weight, confidence = H.cochange_score(F.lit("full"), F.col("left_dense") | F.col("right_dense"), F.col("evidence"))
    return t.select("left", "right", "evidence", "latest", "examples", weight.alias("weight"), confidence.alias("confidence"))


def recently_changed(spark: SparkSession, sf: str) -> DataFrame:
    return H.recently_changed(T.commit_files(spark, sf), T.commits(spark, sf), tasks=T.change_tasks(spark, sf))


def representative_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The three most changed files of each folder."""
    n = T.commit_files(spark, sf).groupBy("path").agg(F.count_distinct("commit_id").alias("commits")).withColumn("dir", paths.directory("path"))
    return top_per(n, "dir", [F.desc("commits"), F.col("path")], 3).select("dir", "path", "commits", "rank")


def workref_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return H.work_references(T.commits(spark, sf), T.commit_files(spark, sf))


def dialect_trust(spark: SparkSession, sf: str) -> DataFrame:
    """Trust labels of work references, with how many there are and the commits and paths behind them."""
    return workref_anchors(spark, sf).groupBy("trust").agg(F.count("*").alias("refs"), F.sum("commits").alias("commits"), F.max("paths").alias("most_paths"))


def workstream_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """References as clusters: why one is rejected, and the strength of the others."""
    r = workref_anchors(spark, sf)
    n = T.table(spark, sf, "part").agg(F.count("*").alias("n"))
    share = F.col("paths") / F.col("n")
    reason = F.when(F.col("commits") < 2, "one_source").when(share > 0.35, "too_common").when(F.col("paths") > 40, "too_large").otherwise("")
    strength = F.when(reason != "", "none").when(F.col("commits") >= 4, "strong").otherwise("medium")
    return r.join(F.broadcast(n)).select("ref", reason.alias("reason"), strength.alias("strength"))


def recent_topics(spark: SparkSession, sf: str) -> DataFrame:
    return H.topics(T.commits(spark, sf), T.commit_files(spark, sf), 25)


def boundary_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Folders at every depth as areas: files, tests, noise, and a confidence tier."""
    f = T.files(spark, sf)
    up = f.select("path", F.explode(paths.ancestors("path")).alias("area"), paths.is_test("path").alias("t"), paths.is_noise("path").alias("v"))
    a = up.groupBy("area").agg(F.count("*").alias("files"), F.count_if("t").alias("tests"), F.count_if("v").alias("noise"))
    tier = F.when((F.col("files") >= 6) & (F.col("tests") > 0) & (F.col("noise") == 0), "high").when(F.col("files") >= 3, "medium").otherwise("low")
    return a.select("area", "files", "tests", tier.alias("confidence"))


QUERIES = {f.__name__: f for f in (commit_size_filter, history_shape, first_commit_dates, cochange_pairs, cochange_scored, recently_changed, representative_paths, workref_anchors, dialect_trust, workstream_clusters, recent_topics, boundary_areas)}

_CF = f"{T.COMMITS}, {T.COMMIT_FILES}, df AS (SELECT DISTINCT commit_id, path FROM commit_files)"
_PAIRS = f"""{_CF}, ok AS (SELECT commit_id FROM df GROUP BY 1 HAVING count(*) <= 32), u AS (SELECT df.* FROM df JOIN ok USING (commit_id)),
p AS (SELECT commit_id, a.path AS "left", b.path AS "right", row_number() OVER (PARTITION BY commit_id ORDER BY a.path, b.path) AS r FROM u a JOIN u b USING (commit_id) WHERE a.path < b.path), pairs AS (SELECT * FROM p WHERE r <= 12)"""
_REFS = rf"""{_CF}, rf AS (SELECT commit_id, unnest(list_distinct(regexp_extract_all(subject, '\b[A-Z][A-Z0-9]{{1,9}}-[0-9]{{1,6}}\b'))) AS ref FROM commits),
ru AS (SELECT ref, count(DISTINCT commit_id) AS commits, count(DISTINCT path) AS paths, count(DISTINCT split_part(path, '/', 2)) AS families FROM rf JOIN commit_files USING (commit_id) GROUP BY ref),
refs AS (SELECT *, CASE WHEN commits >= 3 AND families >= 2 THEN 'trusted' WHEN commits >= 2 THEN 'likely' ELSE 'weak' END AS trust FROM ru)"""
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: strlen(t) >= 3 AND t NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this', 'into', 'are', 'was', 'how', 'what'))[1:4]"
SQL = {
    "commit_size_filter": f"WITH {_CF}, n AS (SELECT commit_id, count(*) AS n FROM df GROUP BY 1) SELECT CASE WHEN n > 32 THEN 'large' WHEN n > 1 THEN 'medium' ELSE 'small' END AS size, count(*) AS commits, CAST(sum(greatest(n - 32, 0)) AS BIGINT) AS dropped FROM n GROUP BY 1",
    "history_shape": "SELECT c_custkey AS author, count(o_orderkey) AS commits, CASE WHEN count(o_orderkey) = 0 THEN 'full' WHEN count(o_orderkey) = 1 THEN 'single_commit' WHEN c_acctbal < 0 THEN 'shallow' ELSE 'full' END AS shape FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal",
    "first_commit_dates": f"WITH {_CF} SELECT path, min(committed_at) AS authored_at FROM commit_files JOIN commits USING (commit_id) WHERE change = 'A' GROUP BY path",
    "cochange_pairs": f'WITH {_PAIRS} SELECT "left", "right", count(*) AS evidence FROM pairs GROUP BY ALL HAVING count(*) >= 2',
    "cochange_scored": f"""WITH {_PAIRS}, l AS (SELECT "left", "right", sha, committed_at, row_number() OVER (PARTITION BY "left", "right" ORDER BY committed_at DESC, sha) AS r FROM pairs JOIN commits USING (commit_id)),
t AS (SELECT "left", "right", count(*) AS evidence, max(committed_at) AS latest, string_agg(sha, ',' ORDER BY r) FILTER (WHERE r <= 3) AS examples FROM l GROUP BY 1, 2)
, den AS (SELECT path, count(*) > 12 AS dense FROM commit_files GROUP BY path), td AS (SELECT t.*, a.dense OR b.dense AS dense FROM t JOIN den a ON a.path = "left" JOIN den b ON b.path = "right")
SELECT "left", "right", evidence, latest, examples, CAST(CASE WHEN dense AND evidence >= 2 THEN 0.58 WHEN dense THEN 0.42 WHEN evidence >= 2 THEN 0.74 ELSE 0.56 END AS DOUBLE) AS weight, CAST(CASE WHEN dense AND evidence >= 2 THEN 0.72 WHEN dense THEN 0.56 WHEN evidence >= 2 THEN 0.86 ELSE 0.64 END AS DOUBLE) AS confidence FROM td ORDER BY evidence DESC, latest DESC, "left", "right" LIMIT 250""",
    "recently_changed": f"WITH {_CF} SELECT path, count(DISTINCT commit_id) AS changes, max(committed_at) AS latest FROM commit_files JOIN commits USING (commit_id) GROUP BY path ORDER BY latest DESC, changes DESC, path LIMIT 80",
    "representative_paths": f"WITH {_CF}, n AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS commits FROM df GROUP BY 1), r AS (SELECT dir, path, commits, row_number() OVER (PARTITION BY dir ORDER BY commits DESC, path) AS rank FROM n) SELECT * FROM r WHERE rank <= 3",
    "workref_anchors": f"WITH {_REFS} SELECT * FROM refs",
    "dialect_trust": f"WITH {_REFS} SELECT trust, count(*) AS refs, CAST(sum(commits) AS BIGINT) AS commits, max(paths) AS most_paths FROM refs GROUP BY trust",
    "workstream_clusters": f"WITH {_REFS}, c AS (SELECT ref, commits, CASE WHEN commits < 2 THEN 'one_source' WHEN paths / (SELECT count(*) FROM part) > 0.35 THEN 'too_common' WHEN paths > 40 THEN 'too_large' ELSE '' END AS reason FROM refs) SELECT ref, reason, CASE WHEN reason <> '' THEN 'none' WHEN commits >= 4 THEN 'strong' ELSE 'medium' END AS strength FROM c",
    "recent_topics": rf"""WITH {_CF}, s AS (SELECT commit_id, committed_at, {_WORDS.format(r"regexp_replace(subject, '^[a-z]+(\([^)]*\))?!?:\s*', '')")} AS w FROM commits WHERE NOT regexp_matches(lower(subject), '^(merge |bump |chore\(deps\)|revert |release |wip\b)')),
j AS (SELECT commit_id, committed_at, path, array_to_string(CASE WHEN len(w) > 0 THEN w ELSE {_WORDS.format(r"regexp_extract(path, '^(.*)/[^/]*$', 1)")} END, ' ') AS topic FROM s JOIN commit_files USING (commit_id)),
g AS (SELECT topic, count(DISTINCT commit_id) AS commits, count(DISTINCT path) AS paths, max(committed_at) AS latest FROM j WHERE topic <> '' GROUP BY topic)
SELECT topic, commits, paths, CAST(12 * commits + 2 * least(paths, 10) AS BIGINT) AS score, latest FROM g ORDER BY score DESC, topic LIMIT 25""",
    "boundary_areas": f"""WITH {T.FILES}, s AS (SELECT path, string_split(path, '/') AS p FROM files), u AS (SELECT path, array_to_string(p[1:i], '/') AS area FROM s, range(1, len(p)) t(i)),
a AS (SELECT area, count(*) AS files, count(*) FILTER (WHERE path LIKE '%\\_test.go' ESCAPE '\\') AS tests, count(*) FILTER (WHERE starts_with(path, 'vendor/')) AS noise FROM u GROUP BY area)
SELECT area, files, tests, CASE WHEN files >= 6 AND tests > 0 AND noise = 0 THEN 'high' WHEN files >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM a""",
}
