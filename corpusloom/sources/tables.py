"""The test tables as the artifact model: artifacts, todos, criteria, tags, commits, files, checkpoints.

Each relation comes twice: as a DataFrame, and as the SQL of a common table expression, so that a query and its SQL start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Plans whose lines one task holds at most, about.
PLANS = 20_000
#: Parts that one task turns into files and their text at most.
PARTS = 50_000
#: Changed files that one task tells apart at most, about.
CHANGES = 400_000


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table over as many tasks as its rows need: a few MB of it become many rows of paths and texts."""
    part = table(spark, sf_dir, "part")
    tasks = -(-part.count() // PARTS)  # from the ends of the files
    return part if part.rdd.getNumPartitions() >= tasks else part.repartition(tasks)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact_id, repo_id, kind, status, title, path, body: documents as planning artifacts."""
    bucket = F.substring("source", 4, 9).cast("int") % 4
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("artifact_id"),
        F.concat(F.lit("repo-"), "source").alias("repo_id"),
        F.when(F.col("lang") == "en", "plan").when(F.col("lang") == "fr", "decision").when(F.col("lang") == "de", "requirements").otherwise("proposal").alias("kind"),
        F.when(bucket == 0, "draft").when(bucket == 1, "active").when(bucket == 2, "accepted").otherwise("superseded").alias("status"),
        F.trim(F.element_at(F.split("text", "\n"), 1)).alias("title"),
        F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("text").alias("body"),
    )


ARTIFACTS = """artifacts AS (SELECT doc_id AS artifact_id, 'repo-' || source AS repo_id,
  CASE lang WHEN 'en' THEN 'plan' WHEN 'fr' THEN 'decision' WHEN 'de' THEN 'requirements' ELSE 'proposal' END AS kind,
  CASE CAST(substr(source, 4, 9) AS INT) % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'active' WHEN 2 THEN 'accepted' ELSE 'superseded' END AS status,
  trim(split_part(text, chr(10), 1)) AS title, 'docs/' || lang || '/' || source || '/' || doc_id || '.md' AS path, text AS body FROM documents)"""


def todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact_id, ordinal, done, kind, text, size: order lines as checklist items."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("artifact_id"),
        F.col("l_linenumber").alias("ordinal"),
        (F.col("l_linestatus") == "F").alias("done"),
        F.when(F.col("l_returnflag") == "A", "acceptance").when(F.col("l_returnflag") == "N", "success").otherwise("okr").alias("kind"),
        F.col("p_name").alias("text"),
        F.col("l_quantity").alias("size"),
    )


TODOS = """todos AS (SELECT l_orderkey AS artifact_id, l_linenumber AS ordinal, l_linestatus = 'F' AS done,
  CASE l_returnflag WHEN 'A' THEN 'acceptance' WHEN 'N' THEN 'success' ELSE 'okr' END AS kind, p_name AS text, l_quantity AS size
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def slug(c: str) -> F.Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, size: parts as source files; every second one has a test, every seventh lies in a vendor folder."""
    part = parts(spark, sf_dir)
    stem = F.concat(F.when(F.col("p_partkey") % 7 == 0, "vendor/").otherwise("src/"), slug("p_type"), F.lit("/"), slug("p_brand"), F.lit("/unit"), F.col("p_partkey").cast("string"))
    ends = F.when(F.col("p_size") % 2 == 0, F.array(F.lit(".go"), F.lit("_test.go"))).otherwise(F.array(F.lit(".go")))
    rows = part.select(F.col("p_partkey").alias("file_id"), stem.alias("stem"), F.explode(ends).alias("end"), F.col("p_size").cast("long").alias("size"))
    return rows.select("file_id", F.concat("stem", "end").alias("path"), "size")


FILES = """files AS (SELECT p_partkey AS file_id, CASE WHEN p_partkey % 7 = 0 THEN 'vendor/' ELSE 'src/' END
  || regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') || '/' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') || '/unit' || p_partkey || e AS path, CAST(p_size AS BIGINT) AS size
  FROM part, (VALUES ('.go', 1), ('_test.go', 2)) v(e, n) WHERE n = 1 OR p_size % 2 = 0)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, commit_id, author, committed_at, subject: orders as commits."""
    return table(spark, sf_dir, "orders").select(
        F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 12).alias("sha"),
        F.col("o_orderkey").alias("commit_id"),
        F.col("o_custkey").alias("author"),
        F.col("o_orderdate").alias("committed_at"),
        F.concat(F.when(F.col("o_orderstatus") == "F", "fix: ").when(F.col("o_orderstatus") == "O", "feat(api): ").otherwise(""), F.lower("o_orderpriority"), F.lit(" OPS-"), (F.col("o_custkey") % 500).cast("string")).alias("subject"),
    )


COMMITS = """commits AS (SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12) AS sha, o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS committed_at,
  CASE o_orderstatus WHEN 'F' THEN 'fix: ' WHEN 'O' THEN 'feat(api): ' ELSE '' END || lower(o_orderpriority) || ' OPS-' || (o_custkey % 500) AS subject FROM orders)"""


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_id, path, change: order lines as changed files."""
    lines = table(spark, sf_dir, "lineitem")
    # a merge join: the table of parts looks small, but its paths grow with it and would be held whole by every task
    paths = files(spark, sf_dir).where(~F.col("path").endswith("_test.go")).hint("merge")
    return lines.join(paths, lines["l_partkey"] == paths["file_id"]).select(
        F.col("l_orderkey").alias("commit_id"), "path", F.when(F.col("l_returnflag") == "N", "A").otherwise("M").alias("change")
    )


COMMIT_FILES = f"""{FILES}, commit_files AS (SELECT l_orderkey AS commit_id, path, CASE l_returnflag WHEN 'N' THEN 'A' ELSE 'M' END AS change
  FROM lineitem JOIN files ON l_partkey = file_id AND path NOT LIKE '%\\_test.go' ESCAPE '\\')"""


def change_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Over how many tasks the rows of commit_files are dealt."""
    return max(-(-table(spark, sf_dir, "lineitem").count() // CHANGES), spark.sparkContext.defaultParallelism)  # from the ends of the files


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """checkpoint_id, target, stage, created_at, score, evidence: events as task checkpoints."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("checkpoint_id"), F.col("user_id").alias("target"), F.col("event_type").alias("stage"), F.col("ts").alias("created_at"), F.col("value").alias("score"), F.col("props").alias("evidence")
    )


CHECKPOINTS = "checkpoints AS (SELECT event_id AS checkpoint_id, user_id AS target, event_type AS stage, ts AS created_at, value AS score, props AS evidence FROM events)"


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact_id, body: each order as a markdown plan with front matter, headings, a fenced block and checklists."""
    lines = todos(spark, sf_dir)
    items = lines.groupBy("artifact_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.when(F.col("done"), "- [x] ").otherwise("- [ ] ").alias("mark"), "text"))), lambda s: F.concat(s["mark"], s["text"])), "\n").alias("items")
    )
    orders = table(spark, sf_dir, "orders")
    body = F.concat(
        F.lit("---\ntitle: Order "), F.col("o_orderkey").cast("string"), F.lit("\nstatus: "), F.lower("o_orderstatus"), F.lit("\n---\n# Order "), F.col("o_orderkey").cast("string"),
        F.lit("\n\nSee [customer](customers/"), F.col("o_custkey").cast("string"), F.lit(".md) and docs/plans/"), (F.col("o_custkey") % 97).cast("string"), F.lit(".md.\n\n## Tasks\n```\n- [ ] not a task\n# not a heading\n```\n"), "items",
        F.lit("\n\n## Acceptance criteria\n- [x] priority "), F.lower("o_orderpriority"), F.lit("\n### Notes\nDone by "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\n"),
    )
    rows = orders.join(items, orders["o_orderkey"] == items["artifact_id"]).select("artifact_id", "items", *[c for c in orders.columns if c != "o_totalprice"])
    # tasks by rows, as each becomes many lines
    tasks = max(-(-orders.count() // PLANS), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "artifact_id").select("artifact_id", body.alias("body"))


MARKDOWN = f"""{TODOS}, items AS (SELECT artifact_id, string_agg(CASE WHEN done THEN '- [x] ' ELSE '- [ ] ' END || text, chr(10) ORDER BY ordinal, CASE WHEN done THEN '- [x] ' ELSE '- [ ] ' END, text) AS items FROM todos GROUP BY artifact_id),
markdown AS (SELECT artifact_id, '---' || chr(10) || 'title: Order ' || o_orderkey || chr(10) || 'status: ' || lower(o_orderstatus) || chr(10) || '---' || chr(10) || '# Order ' || o_orderkey || chr(10) || chr(10)
  || 'See [customer](customers/' || o_custkey || '.md) and docs/plans/' || (o_custkey % 97) || '.md.' || chr(10) || chr(10) || '## Tasks' || chr(10) || '```' || chr(10) || '- [ ] not a task' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10)
  || items || chr(10) || chr(10) || '## Acceptance criteria' || chr(10) || '- [x] priority ' || lower(o_orderpriority) || chr(10) || '### Notes' || chr(10) || 'Done by ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) AS body
  FROM orders JOIN items ON o_orderkey = artifact_id)"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, body: parts as test files of Go, Python or JavaScript, with imports, comments and two tests each."""
    k, name, kind, pack = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type"), F.col("p_brand")
    go = F.concat(F.lit('package unit\n\nimport "fmt"\nimport lib/unit'), k, F.lit("\n// TODO handle "), kind, F.lit("\n// and "), name, F.lit("\nfunc TestUnit"), k, F.lit("(t *testing.T) {\n}\n/* "), pack, F.lit("\n * must never be empty\n */\nfunc TestMore(t *testing.T) {}\nfunc helper() {}\n"))
    py = F.concat(F.lit("import os\nfrom src.unit"), k, F.lit(" import unit\n# because "), name, F.lit("\n# x\nclass TestUnit"), k, F.lit(":\n    def test_first(self):\n        pass\n    def test_"), k, F.lit("(self):\n        pass\n"))
    js = F.concat(F.lit("import x from './lib/unit"), k, F.lit("'\nconst y = require('react')\n// for now "), name, F.lit("\ndescribe('"), kind, F.lit("', () => {\n  it('holds "), name, F.lit("', f)\n  test.only(\"more\", g)\n})\n"))
    of = lambda a, b, c: F.when(F.col("p_size") % 3 == 0, a).when(F.col("p_size") % 3 == 1, b).otherwise(c)
    path = of(F.concat(F.lit("pkg/unit"), k, F.lit("_test.go")), F.concat(F.lit("tests/test_unit"), k, F.lit(".py")), F.concat(F.lit("web/unit"), k, F.lit(".spec.js")))
    return parts(spark, sf_dir).select(path.alias("path"), of(go, py, js).alias("body"))


CODE_FILES = """code_files AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_name AS name, p_type AS kind, p_brand AS pack, CASE p_size % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'python' ELSE 'javascript' END AS language,
  CASE p_size % 3 WHEN 0 THEN 'pkg/unit' || p_partkey || '_test.go' WHEN 1 THEN 'tests/test_unit' || p_partkey || '.py' ELSE 'web/unit' || p_partkey || '.spec.js' END AS path FROM part)"""
