"""State: upserts, last write, scoped replacement, checkpoints, next slices, completeness, audits, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import state as S
from ..sources import tables as T
from ..streaming.incremental import checkpoint_counts


def upsert_states(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by the digest of their last order: the table holds what finished orders say, the scan what all others say."""
    o = T.table(spark, sf, "orders")
    last = F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey"))
    version = lambda df: df.groupBy("o_custkey").agg(content_hash(last).alias("digest"))
    return S.upsert_states(version(o.where("o_orderstatus = 'F'")), version(o.where("o_orderstatus != 'F'")), "o_custkey", "digest")


def last_write(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return S.last_write(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """All kinds of parts are inserted into those of which a full lot was returned."""
    p = T.table(spark, sf, "part")
    lots = T.table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    have = p.join(lots, "p_partkey", "left_semi").select("p_brand", "p_type").distinct().withColumn("origin", F.lit("old"))
    return S.insert_or_ignore(have, p.select("p_brand", "p_type", F.lit("new").alias("origin")), ["p_brand", "p_type"])


def replace_scope(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of one kind (order lines flagged N) are replaced by those of a new run, the others stay."""
    line = T.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return S.replace_scope(line.withColumn("run", F.lit(1)), line.where("l_returnflag = 'N'").withColumn("run", F.lit(2)), ["l_returnflag"])


def latest_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return S.latest_checkpoints(T.checkpoints(spark, sf))


def next_slice(spark: SparkSession, sf: str) -> DataFrame:
    return S.next_items(T.todos(spark, sf), "artifact_id").select("artifact_id", F.col("ordinal").cast("long").alias("ordinal"), "text", "open", "total")


def terminal_states(spark: SparkSession, sf: str) -> DataFrame:
    """The stage that follows from each decision, and whether it ends the target."""
    c = T.checkpoints(spark, sf)
    nxt = F.when(F.col("stage") == "purchase", "closed").when(F.col("stage").isin("click", "view"), "in_progress").otherwise("blocked")
    return c.groupBy("stage", nxt.alias("next"), F.col("stage").isin("purchase").alias("terminal")).agg(F.count("*").alias("n"))


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Which users went through all of four stages."""
    c = T.checkpoints(spark, sf)
    required = c.select("target").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, ("view", "click", "purchase", "refund")))))
    return S.completeness(required, c, "target", "stage")


def audit_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Files that each author changed outside the allowed folder."""
    f = T.commit_files(spark, sf).join(T.commits(spark, sf).select("commit_id", "author"), "commit_id")
    return f.where(~F.col("path").startswith("src/")).groupBy("author").agg(F.count_distinct("path").alias("outside"), F.min("path").alias("first_path"))


def confidence_by_count(spark: SparkSession, sf: str) -> DataFrame:
    n = T.checkpoints(spark, sf).groupBy("target", "stage").agg(F.count("*").alias("n"))
    return n.select("target", "stage", F.when(F.col("n") >= 15, "high").when(F.col("n") >= 8, "medium").otherwise("low").alias("confidence"))


def risk_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence values of low-scored checkpoints, de-duplicated and counted; the two most frequent of each target."""
    c = T.checkpoints(spark, sf).where("score < 20").select("target", F.get_json_object("evidence", "$.k").cast("long").alias("k"))
    n = c.groupBy("target", "k").agg(F.count("*").alias("n"))
    from ..operators.search import top_per

    return top_per(n, "target", [F.desc("n"), F.col("k")], 2)


def checkpoint_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming count on a finite table: six-hour windows by stage."""
    c = T.checkpoints(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    out = checkpoint_counts(c, "6 hours")
    return out.select("stage", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("score", 4).alias("score"))


def refresh_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rows by language, with totals: what a rescan would visit."""
    from ..functions import paths

    f = T.files(spark, sf)
    return f.groupBy(paths.path_class("path").alias("class"), paths.language("path").alias("language")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("path").alias("last_path"))


QUERIES = {f.__name__: f for f in (upsert_states, last_write, insert_or_ignore, replace_scope, latest_checkpoints, next_slice, terminal_states, completeness, audit_surface, confidence_by_count, risk_cards, checkpoint_windows, refresh_plan)}
SQL = {
    "upsert_states": """WITH c AS (SELECT o_custkey, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS old FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), i AS (SELECT o_custkey, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS new FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT o_custkey, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'missing' WHEN old = new THEN 'unchanged' ELSE 'updated' END AS state FROM c FULL JOIN i USING (o_custkey)""",
    "last_write": "WITH r AS (SELECT user_id, event_type, event_id, ts, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, ts, value FROM r WHERE r = 1",
    "insert_or_ignore": "SELECT p_brand, p_type, CASE WHEN bool_or(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50)) THEN 'old' ELSE 'new' END AS origin FROM part GROUP BY 1, 2",
    "replace_scope": "SELECT l_returnflag, l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 2 ELSE 1 END AS run FROM lineitem",
    "latest_checkpoints": f"WITH {T.CHECKPOINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY created_at DESC, checkpoint_id DESC) AS r, count(*) OVER (PARTITION BY target) AS checkpoints FROM checkpoints) SELECT target, created_at, checkpoint_id, stage, score, checkpoints FROM r WHERE r = 1",
    "next_slice": f"""WITH {T.TODOS}, r AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY done, ordinal, text) AS r FROM todos), g AS (SELECT artifact_id, count(*) FILTER (WHERE NOT done) AS open, count(*) AS total FROM todos GROUP BY 1)
SELECT artifact_id, CASE WHEN NOT done THEN CAST(ordinal AS BIGINT) END AS ordinal, CASE WHEN NOT done THEN text END AS text, open, total FROM r JOIN g USING (artifact_id) WHERE r = 1""",
    "terminal_states": f"WITH {T.CHECKPOINTS} SELECT stage, CASE WHEN stage = 'purchase' THEN 'closed' WHEN stage IN ('click', 'view') THEN 'in_progress' ELSE 'blocked' END AS next, stage = 'purchase' AS terminal, count(*) AS n FROM checkpoints GROUP BY ALL",
    "completeness": f"WITH {T.CHECKPOINTS} SELECT target, CAST(4 AS BIGINT) AS required, count(DISTINCT stage) FILTER (WHERE stage IN ('view', 'click', 'purchase', 'refund')) AS present, count(DISTINCT stage) FILTER (WHERE stage IN ('view', 'click', 'purchase', 'refund')) = 4 AS complete FROM checkpoints GROUP BY target",
    "audit_surface": f"WITH {T.COMMITS}, {T.COMMIT_FILES} SELECT author, count(DISTINCT path) AS outside, min(path) AS first_path FROM commit_files JOIN commits USING (commit_id) WHERE NOT starts_with(path, 'src/') GROUP BY author",
    "confidence_by_count": f"WITH {T.CHECKPOINTS} SELECT target, stage, CASE WHEN count(*) >= 15 THEN 'high' WHEN count(*) >= 8 THEN 'medium' ELSE 'low' END AS confidence FROM checkpoints GROUP BY target, stage",
    "risk_cards": f"WITH {T.CHECKPOINTS}, n AS (SELECT target, CAST(json_extract_string(evidence, '$.k') AS BIGINT) AS k, count(*) AS n FROM checkpoints WHERE score < 20 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, k) AS rank FROM n) SELECT * FROM r WHERE rank <= 2",
    "checkpoint_windows": f"WITH {T.CHECKPOINTS} SELECT stage, strftime(time_bucket(INTERVAL 6 HOURS, created_at), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(score), 4) AS score FROM checkpoints GROUP BY ALL",
    "refresh_plan": f"WITH {T.FILES} SELECT CASE WHEN starts_with(path, 'vendor/') THEN 'noise' WHEN path LIKE '%\\_test.go' ESCAPE '\\' THEN 'test' ELSE 'source' END AS class, 'go' AS language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, max(path) AS last_path FROM files GROUP BY ALL",
}
