"""Listing reports: filters, lookups, hydration, tags, resume buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import glob_matches, glob_regex
from ..operators.selection import numbered
from ..sources import tables as T
from ..sources.files import ignored, ignore_regexes


def list_filtered(spark: SparkSession, sf: str) -> DataFrame:
    a = T.artifacts(spark, sf)
    return a.where((F.col("kind") == "plan") & F.col("status").isin("active", "accepted")).select("artifact_id", "repo_id", "kind", "status", "title", "path")


def count_distinct_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return T.artifacts(spark, sf).groupBy("kind", "status").agg(F.count_distinct("artifact_id").alias("artifacts"), F.count_distinct("repo_id").alias("repos"))


def ids_in_input_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a list of ids in the order of the list, each id once."""
    ids = T.table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("artifact_id"))
    first = ids.groupBy("artifact_id").agg(F.min("pos").alias("pos"))
    return numbered(T.artifacts(spark, sf).join(first, "artifact_id").select("pos", "artifact_id", "title"), "pos", "place")


def get_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Exact id, else exact short id, else prefix: the best tier's rows, and whether the answer is ambiguous."""
    a = T.artifacts(spark, sf).select("artifact_id", F.substring(F.sha2(F.col("artifact_id").cast("string"), 256), 1, 8).alias("short_id"))
    wanted = T.table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey").cast("string")).when(F.col("n_nationkey") % 3 == 1, F.substring(F.sha2(F.col("n_nationkey").cast("string"), 256), 1, 8)).otherwise(F.substring(F.sha2(F.col("n_nationkey").cast("string"), 256), 1, 2)).alias("wanted"))
    exact = wanted.join(a, F.col("wanted") == F.col("artifact_id").cast("string")).select("wanted", "artifact_id", F.lit(0).alias("tier"))
    short = wanted.join(a, F.col("wanted") == F.col("short_id")).select("wanted", "artifact_id", F.lit(1).alias("tier"))
    heads = a.select("artifact_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.substring("short_id", F.lit(1), i))).alias("head"))
    prefix = wanted.join(heads, F.col("wanted") == F.col("head")).select("wanted", "artifact_id", F.lit(2).alias("tier"))
    every = exact.unionByName(short).unionByName(prefix)
    best = every.withColumn("best", F.min("tier").over(Window.partitionBy("wanted"))).where("tier = best")
    return best.groupBy("wanted", "tier").agg(F.min("artifact_id").alias("artifact_id"), (F.count("*") > 1).alias("ambiguous"))


def todos_open(spark: SparkSession, sf: str) -> DataFrame:
    t = T.todos(spark, sf).where(~F.col("done"))
    return t.groupBy("artifact_id").agg(F.count("*").alias("open"), F.min("ordinal").cast("long").alias("first_ordinal"))


def criteria_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return T.todos(spark, sf).groupBy(F.col("kind").alias("criteria_kind")).agg(F.count("*").alias("n"), F.count_if("done").alias("done"), F.count_distinct("artifact_id").alias("artifacts"))


def like_search(spark: SparkSession, sf: str) -> DataFrame:
    a = T.artifacts(spark, sf)
    q = "%tion the%"
    return a.where(F.col("title").ilike(q) | F.col("path").ilike(q) | F.col("body").ilike(q)).select("artifact_id", F.col("title").ilike(q).alias("in_title"))


def title_path_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("thea", "src1", "/fr/")))
    a = T.artifacts(spark, sf).select("artifact_id", F.size(F.filter(terms, lambda t: F.contains(F.lower("title"), t) | F.contains(F.lower("path"), t))).cast("long").alias("hits"))
    return a.where("hits > 0")


def glob_match(spark: SparkSession, sf: str) -> DataFrame:
    f = T.files(spark, sf)
    return f.select("path", glob_matches("path", "src/**/unit?5*.go").alias("deep"), glob_matches("path", "vendor/*/*/*.go").alias("flat")).where("deep OR flat")


IGNORE = "vendor/\n*_test.go\n!unit12*_test.go\nsrc/economy-*/**\n"


def ignored_paths(spark: SparkSession, sf: str) -> DataFrame:
    return T.files(spark, sf).select("path", ignored("path", IGNORE).alias("ignored"))


def _ignored_sql() -> str:
    case = "FALSE"
    for negated, regex in ignore_regexes(IGNORE):
        case = f"CASE WHEN regexp_matches(path, '{regex}') THEN {not negated} ELSE {case} END"
    return case


def path_classes(spark: SparkSession, sf: str) -> DataFrame:
    return T.files(spark, sf).select("path", paths.path_class("path").alias("class"), paths.base("path").alias("base"), paths.directory("path").alias("directory"), paths.extension("path").alias("ext"), paths.source_stem("path").alias("stem"), paths.depth("path").alias("depth"), paths.language("path").alias("language"))


def hydration(spark: SparkSession, sf: str) -> DataFrame:
    """Each artifact with its todos and files as ordered lists; each child is aggregated before it is joined."""
    todos = T.todos(spark, sf).groupBy("artifact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "|").alias("todos"))
    changed = T.commit_files(spark, sf).groupBy(F.col("commit_id").alias("artifact_id")).agg(F.array_join(F.array_sort(F.collect_set("path")), "|").alias("paths"))
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("artifact_id")).join(todos, "artifact_id", "left").join(changed, "artifact_id", "left").select("artifact_id", F.coalesce("todos", F.lit("")).alias("todos"), F.coalesce("paths", F.lit("")).alias("paths"))


def resume_counts_tags(spark: SparkSession, sf: str) -> DataFrame:
    """First path, counts and ordered tags of each repository, without a product of the children."""
    a = T.artifacts(spark, sf)
    counts = a.groupBy("repo_id").agg(F.min("path").alias("first_path"), F.count("*").alias("artifacts"), F.count_if(F.col("status") == "draft").alias("drafts"))
    tags = a.select("repo_id", "kind").distinct().groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("kind")), ", ").alias("tags"))
    return counts.join(tags, "repo_id", "left")


def resume_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """In progress, settled in the last 14 days, or idle for 30, as of a given day."""
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    last = T.checkpoints(spark, sf).groupBy("target").agg(F.max("created_at").alias("seen"), F.max_by("stage", F.struct("created_at", "checkpoint_id")).alias("stage"))
    idle = F.datediff(as_of, F.col("seen"))
    bucket = F.when((F.col("stage") == "purchase") & (idle <= 14), "settled").when(idle >= 30, "stale").when(F.col("stage") == "purchase", "done").otherwise("in_progress")
    return last.select("target", "stage", idle.cast("long").alias("idle_days"), bucket.alias("bucket"))


def longest_prefix_root(spark: SparkSession, sf: str) -> DataFrame:
    """Each file's deepest source root: the path's ancestors are joined with the roots, no prefix is compared pairwise."""
    f = T.files(spark, sf)
    roots = f.where(F.col("path").startswith("src/")).select(F.element_at(paths.ancestors("path"), 2).alias("root")).distinct().unionByName(spark.createDataFrame([("src",), ("vendor",)], "root string"))
    up = f.select("path", F.explode(paths.ancestors("path")).alias("root"))
    return up.join(roots, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def suffix_index(spark: SparkSession, sf: str) -> DataFrame:
    """Suffixes of two segments that belong to one file only."""
    s = T.files(spark, sf).select("path", F.explode(F.slice(paths.suffixes("path"), 1, 2)).alias("suffix"))
    return s.groupBy("suffix").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path")).where("n = 1").select("suffix", "path")


def test_companions(spark: SparkSession, sf: str) -> DataFrame:
    """Test files with the source that their name points to, if it exists."""
    f = T.files(spark, sf)
    tests = f.where(paths.is_test("path")).select(F.col("path").alias("test"), F.regexp_replace("path", r"_test\.go$", ".go").alias("path"))
    return tests.join(f.where(~paths.is_test("path")).select("path", F.col("size").alias("source_size")), "path").select("test", F.col("path").alias("source"), "source_size")


def fan_out_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Two independent children of a parent, each collapsed before the join."""
    a = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))
    c = T.table(spark, sf, "customer")
    b = T.table(spark, sf, "nation").select("n_nationkey", "n_name")
    s = T.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    return c.join(a, c["c_custkey"] == a["id"], "left").join(b, c["c_nationkey"] == b["n_nationkey"]).join(s, c["c_nationkey"] == s["s_nationkey"], "left").select("c_custkey", "n_name", F.coalesce("priorities", F.lit("")).alias("priorities"), F.coalesce("suppliers", F.lit(0).cast("long")).alias("suppliers"))


def todo_tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A tag filter is a semi join, made only because the filter asks for it; deletes by tag are the anti join."""
    part = T.table(spark, sf, "part")
    tagged = part.where(F.col("p_brand") == "Brand#11").select(F.col("p_partkey").alias("l_partkey"))
    lines = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    kept = lines.join(tagged, "l_partkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("tagged"))
    gone = lines.join(tagged, "l_partkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("untagged"))
    return kept.join(gone, "l_orderkey", "full").select("l_orderkey", F.coalesce("tagged", F.lit(0).cast("long")).alias("tagged"), F.coalesce("untagged", F.lit(0).cast("long")).alias("untagged"))


QUERIES = {f.__name__: f for f in (list_filtered, count_distinct_filtered, ids_in_input_order, get_by_prefix, todos_open, criteria_by_kind, like_search, title_path_terms, glob_match, ignored_paths, path_classes, hydration, resume_counts_tags, resume_buckets, longest_prefix_root, suffix_index, test_companions, fan_out_collapse, todo_tag_filter)}

_TEST = r"regexp_matches(path, '(^|/)(tests?|spec|__tests__)/|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*$')"
SQL = {
    "list_filtered": f"WITH {T.ARTIFACTS} SELECT artifact_id, repo_id, kind, status, title, path FROM artifacts WHERE kind = 'plan' AND status IN ('active', 'accepted')",
    "count_distinct_filtered": f"WITH {T.ARTIFACTS} SELECT kind, status, count(DISTINCT artifact_id) AS artifacts, count(DISTINCT repo_id) AS repos FROM artifacts GROUP BY ALL",
    "ids_in_input_order": f"WITH {T.ARTIFACTS}, ids AS (SELECT user_id AS artifact_id, min(event_id) AS pos FROM events GROUP BY 1) SELECT pos, artifact_id, title, row_number() OVER (ORDER BY pos) AS place FROM artifacts JOIN ids USING (artifact_id)",
    "get_by_prefix": """WITH a AS (SELECT doc_id AS artifact_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS short_id FROM documents),
w AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN CAST(n_nationkey AS VARCHAR) WHEN 1 THEN substr(sha256(CAST(n_nationkey AS VARCHAR)), 1, 8) ELSE substr(sha256(CAST(n_nationkey AS VARCHAR)), 1, 2) END AS wanted FROM nation),
e AS (SELECT wanted, artifact_id, 0 AS tier FROM w JOIN a ON wanted = CAST(artifact_id AS VARCHAR) UNION ALL SELECT wanted, artifact_id, 1 FROM w JOIN a ON wanted = short_id
  UNION ALL SELECT wanted, artifact_id, 2 FROM w JOIN a ON starts_with(short_id, wanted) AND short_id <> wanted),
b AS (SELECT *, min(tier) OVER (PARTITION BY wanted) AS best FROM e)
SELECT wanted, tier, min(artifact_id) AS artifact_id, count(*) > 1 AS ambiguous FROM b WHERE tier = best GROUP BY wanted, tier""",
    "todos_open": f"WITH {T.TODOS} SELECT artifact_id, count(*) AS open, CAST(min(ordinal) AS BIGINT) AS first_ordinal FROM todos WHERE NOT done GROUP BY artifact_id",
    "criteria_by_kind": f"WITH {T.TODOS} SELECT kind AS criteria_kind, count(*) AS n, count(*) FILTER (WHERE done) AS done, count(DISTINCT artifact_id) AS artifacts FROM todos GROUP BY kind",
    "like_search": f"WITH {T.ARTIFACTS} SELECT artifact_id, title ILIKE '%tion the%' AS in_title FROM artifacts WHERE title ILIKE '%tion the%' OR path ILIKE '%tion the%' OR body ILIKE '%tion the%'",
    "title_path_terms": f"WITH {T.ARTIFACTS}, h AS (SELECT artifact_id, CAST(len(list_filter(['thea', 'src1', '/fr/'], lambda t: contains(lower(title), t) OR contains(lower(path), t))) AS BIGINT) AS hits FROM artifacts) SELECT * FROM h WHERE hits > 0",
    "glob_match": f"WITH {T.FILES}, g AS (SELECT path, regexp_matches(path, '{glob_regex('src/**/unit?5*.go')}') AS deep, regexp_matches(path, '{glob_regex('vendor/*/*/*.go')}') AS flat FROM files) SELECT * FROM g WHERE deep OR flat",
    "ignored_paths": f"WITH {T.FILES} SELECT path, {_ignored_sql()} AS ignored FROM files",
    "path_classes": rf"""WITH {T.FILES}, p AS (SELECT path, split_part(path, '/', -1) AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM files),
e AS (SELECT *, lower(regexp_extract(base, '\.([^.]+)$', 1)) AS ext FROM p)
SELECT path, CASE WHEN regexp_matches(path, '(^|/)(archive|archived)/') THEN 'archive' WHEN regexp_matches(path, '(^|/)(vendor|node_modules|dist|build|generated|archive|\.git)/|\.(lock|min\.js|map)$|(^|/)(package-lock\.json|go\.sum)$') THEN 'noise' WHEN {_TEST} THEN 'test' WHEN ext = 'go' THEN 'source' ELSE 'other' END AS class,
  base, directory, ext, regexp_replace(lower(regexp_replace(base, '\.[^.]+$', '')), '^test[_-]|[._-](?:test|spec|tests)$', '', 'g') AS stem, CAST(len(string_split(path, '/')) AS BIGINT) AS depth, CASE ext WHEN 'go' THEN 'go' ELSE 'other' END AS language FROM e""",
    "hydration": f"""WITH {T.TODOS}, {T.COMMIT_FILES}, t AS (SELECT artifact_id, string_agg(text, '|' ORDER BY ordinal, text) AS todos FROM todos GROUP BY 1),
f AS (SELECT commit_id AS artifact_id, string_agg(DISTINCT path, '|' ORDER BY path) AS paths FROM commit_files GROUP BY 1)
SELECT o_orderkey AS artifact_id, coalesce(todos, '') AS todos, coalesce(paths, '') AS paths FROM orders LEFT JOIN t ON t.artifact_id = o_orderkey LEFT JOIN f ON f.artifact_id = o_orderkey""",
    "resume_counts_tags": f"WITH {T.ARTIFACTS} SELECT repo_id, min(path) AS first_path, count(*) AS artifacts, count(*) FILTER (WHERE status = 'draft') AS drafts, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS tags FROM artifacts GROUP BY repo_id",
    "resume_buckets": f"""WITH {T.CHECKPOINTS}, l AS (SELECT target, max(created_at) AS seen, max_by(stage, (created_at, checkpoint_id)) AS stage FROM checkpoints GROUP BY target),
d AS (SELECT target, stage, datediff('day', CAST(seen AS DATE), DATE '2024-01-31') AS idle_days FROM l)
SELECT target, stage, CAST(idle_days AS BIGINT) AS idle_days, CASE WHEN stage = 'purchase' AND idle_days <= 14 THEN 'settled' WHEN idle_days >= 30 THEN 'stale' WHEN stage = 'purchase' THEN 'done' ELSE 'in_progress' END AS bucket FROM d""",
    "longest_prefix_root": f"""WITH {T.FILES}, roots AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS root FROM files WHERE starts_with(path, 'src/') UNION SELECT 'src' UNION SELECT 'vendor')
SELECT path, max_by(root, length(root)) AS root FROM files JOIN roots ON starts_with(path, root || '/') GROUP BY path""",
    "suffix_index": f"""WITH {T.FILES}, s AS (SELECT path, split_part(path, '/', -1) AS suffix FROM files UNION ALL SELECT path, split_part(path, '/', -2) || '/' || split_part(path, '/', -1) FROM files)
SELECT suffix, min(path) AS path FROM s GROUP BY suffix HAVING count(DISTINCT path) = 1""",
    "test_companions": rf"WITH {T.FILES} SELECT t.path AS test, s.path AS source, s.size AS source_size FROM files t JOIN files s ON regexp_replace(t.path, '_test\.go$', '.go') = s.path WHERE t.path LIKE '%\_test.go' ESCAPE '\' AND s.path NOT LIKE '%\_test.go' ESCAPE '\'",
    "fan_out_collapse": """WITH a AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1), s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT c_custkey, n_name, coalesce(priorities, '') AS priorities, coalesce(suppliers, 0) AS suppliers FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN a ON o_custkey = c_custkey LEFT JOIN s ON s_nationkey = c_nationkey""",
    "todo_tag_filter": """WITH t AS (SELECT l_orderkey, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_brand = 'Brand#11') AS tag FROM lineitem)
SELECT l_orderkey, count(*) FILTER (WHERE tag) AS tagged, count(*) FILTER (WHERE NOT tag) AS untagged FROM t GROUP BY 1""",
}
