"""Retrieval quality: cases from labels, recall and graded precision, hits, budgets, lanes, timings, regression gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import evaluation as E
from ..operators.search import top_per
from ..sources import tables as T

CASES = 16
BUDGETS = (1024, 2048, 4096, 8192)


def _relevance(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, doc, grade: the labelled documents of a case."""
    grade = F.when(F.col("toxic") == 1, "hard_negative").when(F.col("quality") == 1, "must").otherwise("background")
    return T.table(spark, sf, "labels").select((F.col("doc_id") % CASES).alias("case_id"), F.col("doc_id").alias("doc"), grade.alias("grade"))


def _retrieved(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, doc, rank, tokens, lane: the ten longest documents of a case."""
    d = T.table(spark, sf, "documents").select((F.col("doc_id") % CASES).alias("case_id"), F.col("doc_id").alias("doc"), token_estimate("text").alias("tokens"), F.col("lang").alias("lane"))
    return top_per(d, "case_id", [F.desc("tokens"), F.col("doc")], 10)


_CASE = f"""rel AS (SELECT doc_id % {CASES} AS case_id, doc_id AS doc, CASE WHEN toxic = 1 THEN 'hard_negative' WHEN quality = 1 THEN 'must' ELSE 'background' END AS grade FROM labels),
dd AS (SELECT doc_id % {CASES} AS case_id, doc_id AS doc, (strlen(text) + 3) // 4 AS tokens, lang AS lane FROM documents), rt AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY tokens DESC, doc) AS rank FROM dd),
got AS (SELECT rt.*, coalesce(grade, 'none') AS grade, CAST(CASE grade WHEN 'must' THEN 1.0 WHEN 'background' THEN 0.3 WHEN 'hard_negative' THEN -1.0 ELSE 0.0 END AS DOUBLE) AS worth FROM rt LEFT JOIN rel USING (case_id, doc) WHERE rank <= 10),
need AS (SELECT case_id, count(*) FILTER (WHERE grade = 'must') AS must FROM rel GROUP BY 1),
per AS (SELECT case_id, count(*) AS retrieved, count(*) FILTER (WHERE grade = 'must') AS must_found, count(*) FILTER (WHERE grade IN ('must', 'background')) AS useful, sum(greatest(worth, 0)) AS gain, sum(worth) AS net, min(rank) FILTER (WHERE grade = 'must') AS first_must FROM got GROUP BY 1),
met AS (SELECT case_id, coalesce(retrieved, 0) AS retrieved, round(coalesce(must_found, 0) / nullif(must, 0), 6) AS recall, round(useful / retrieved, 6) AS precision, round(gain / retrieved, 6) AS graded_precision, round(greatest(net, 0) / retrieved, 6) AS penalized_precision, first_must,
  coalesce(first_must <= 1, FALSE) AS hit_1, coalesce(first_must <= 3, FALSE) AS hit_3, coalesce(first_must <= 5, FALSE) AS hit_5, coalesce(first_must <= 10, FALSE) AS hit_10 FROM need LEFT JOIN per USING (case_id))"""


def _got(spark: SparkSession, sf: str) -> DataFrame:
    return E.graded(_retrieved(spark, sf), _relevance(spark, sf))


def graded_precision(spark: SparkSession, sf: str) -> DataFrame:
    return E.case_metrics(_got(spark, sf), _relevance(spark, sf))


def hit_at_k(spark: SparkSession, sf: str) -> DataFrame:
    m = graded_precision(spark, sf)
    return m.agg(F.count("*").alias("cases"), *[F.round(F.avg(F.col(f"hit_{k}").cast("int")), 6).alias(f"hit_{k}") for k in (1, 3, 5, 10)], F.round(F.avg("recall"), 6).alias("recall"), F.round(F.median("precision"), 6).alias("median_precision"), F.min_by("case_id", F.struct("precision", "case_id")).alias("worst"))


def budget_sufficiency(spark: SparkSession, sf: str) -> DataFrame:
    """Share of cases whose first must fits into each token budget, whole documents in rank order."""
    w = Window.partitionBy("case_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = _got(spark, sf).withColumn("upto", F.sum("tokens").over(w)).groupBy("case_id").agg(F.min(F.when(F.col("grade") == "must", F.col("upto"))).alias("need"))
    each = need.withColumn("budget", F.explode(F.array(*map(F.lit, BUDGETS))))
    return each.groupBy(F.col("budget").cast("long").alias("budget")).agg(F.count("*").alias("cases"), F.round(F.avg(F.coalesce(F.col("need") <= F.col("budget"), F.lit(False)).cast("int")), 6).alias("passed"))


def lane_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Each lane of a fixed list, also where nothing came by it."""
    lanes = spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "it")], "lane string")
    n = _got(spark, sf).groupBy("lane").agg(F.count("*").alias("n"), F.count_if(F.col("grade") == "must").alias("must"), F.count_if(F.col("grade") == "hard_negative").alias("negative"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return lanes.join(n, "lane", "left").select("lane", zero("n"), zero("must"), zero("negative"))


def token_reduction(spark: SparkSession, sf: str) -> DataFrame:
    whole = T.table(spark, sf, "documents").groupBy((F.col("doc_id") % CASES).alias("case_id")).agg(F.sum(token_estimate("text")).alias("whole"))
    used = _retrieved(spark, sf).groupBy("case_id").agg(F.sum("tokens").alias("used"))
    return whole.join(used, "case_id").select("case_id", "whole", "used", E.token_reduction(F.col("used"), F.col("whole")).alias("reduction"))


def miss_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Musts that were not retrieved by language of the document, with up to eight examples."""
    missed = _relevance(spark, sf).where("grade = 'must'").join(_retrieved(spark, sf).select("case_id", "doc"), ["case_id", "doc"], "left_anti")
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "lang")
    m = missed.join(d, "doc")
    first = top_per(m, "lang", [F.col("doc")], 8, "r").groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc")), lambda x: x.cast("string")), ",").alias("examples"))
    return m.groupBy("lang").agg(F.count("*").alias("n")).join(first, "lang")


def timing_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").select("event_type", F.round(F.col("value") * 10).cast("long").alias("ms"))
    return E.timing_stats(e, "event_type", "ms")


def slowest_cases(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events")
    return top_per(e.select("event_type", "event_id", "value"), "event_type", [F.desc("value"), F.col("event_id")], 5)


def regression_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Event sums of the second half of the month against the first, by user."""
    e = T.table(spark, sf, "events").select("user_id", F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), F.round("value").cast("long").alias("ms")).toDF("user_id", "early", "ms")
    side = lambda c: e.where(c).groupBy("user_id").agg(F.sum("ms").alias("ms"))
    return E.regression_gate(side(F.col("early")), side(~F.col("early")), "user_id", "ms", 1.3, 50)


def output_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an expected list that the given one lacks, and the other way round, with repeats: all orders, against those
    that are not pending, finished urgent ones under another key."""
    o = T.table(spark, sf, "orders")
    want = o.select(F.col("o_custkey").alias("k"), "o_orderpriority")
    moved = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    have = o.where("o_orderstatus != 'P'").select(F.when(moved, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("k"), "o_orderpriority")
    return want.exceptAll(have).withColumn("side", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("side", F.lit("extra"))).groupBy("side", "k", "o_orderpriority").agg(F.count("*").alias("n"))


def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    c = T.table(spark, sf, "conversations").groupBy("role").agg(F.sum(token_estimate("text")).alias("tokens"))
    return c.select("role", "tokens", F.round(F.col("tokens") * F.lit(3.0) / 1_000_000, 6).alias("cost"), F.when(F.col("tokens") < 1000, "<1k").when(F.col("tokens") < 100_000, "1k-100k").otherwise(">=100k").alias("bucket"))


QUERIES = {f.__name__: f for f in (graded_precision, hit_at_k, budget_sufficiency, lane_metrics, token_reduction, miss_classes, timing_percentiles, slowest_cases, regression_gate, output_diff, cost_estimate)}
SQL = {
    "graded_precision": f"WITH {_CASE} SELECT * FROM met",
    "hit_at_k": f"WITH {_CASE} SELECT count(*) AS cases, round(avg(hit_1::INT), 6) AS hit_1, round(avg(hit_3::INT), 6) AS hit_3, round(avg(hit_5::INT), 6) AS hit_5, round(avg(hit_10::INT), 6) AS hit_10, round(avg(recall), 6) AS recall, round(median(precision), 6) AS median_precision, arg_min(case_id, (precision, case_id)) AS worst FROM met",
    "budget_sufficiency": f"""WITH {_CASE}, u AS (SELECT case_id, grade, sum(tokens) OVER (PARTITION BY case_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM got), n AS (SELECT case_id, min(upto) FILTER (WHERE grade = 'must') AS need FROM u GROUP BY 1)
SELECT CAST(b AS BIGINT) AS budget, count(*) AS cases, round(avg(coalesce(need <= b, FALSE)::INT), 6) AS passed FROM n, (VALUES (1024), (2048), (4096), (8192)) v(b) GROUP BY b""",
    "lane_metrics": f"WITH {_CASE} SELECT l AS lane, count(doc) AS n, count(*) FILTER (WHERE grade = 'must') AS must, count(*) FILTER (WHERE grade = 'hard_negative') AS negative FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) v(l) LEFT JOIN got ON lane = l GROUP BY l",
    "token_reduction": f"WITH {_CASE}, w AS (SELECT case_id, CAST(sum(tokens) AS BIGINT) AS whole, CAST(sum(tokens) FILTER (WHERE rank <= 10) AS BIGINT) AS used FROM rt GROUP BY 1) SELECT case_id, whole, used, round(1 - used / nullif(whole, 0), 6) AS reduction FROM w",
    "miss_classes": f"WITH {_CASE}, m AS (SELECT doc, lane AS lang, row_number() OVER (PARTITION BY lane ORDER BY doc) AS r FROM rt JOIN rel USING (case_id, doc) WHERE rank > 10 AND grade = 'must') SELECT lang, count(*) AS n, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY doc) FILTER (WHERE r <= 8) AS examples FROM m GROUP BY lang",
    "timing_percentiles": "WITH e AS (SELECT event_type, CAST(round(value * 10) AS BIGINT) AS ms FROM events) SELECT event_type, CAST(sum(ms) AS BIGINT) AS total, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS most, count(*) AS n FROM e GROUP BY 1",
    "slowest_cases": "WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) SELECT * FROM r WHERE rank <= 5",
    "regression_gate": """WITH e AS (SELECT user_id, ts < TIMESTAMP '2024-01-16' AS early, CAST(round(value) AS BIGINT) AS ms FROM events), s AS (SELECT user_id, CAST(sum(ms) FILTER (WHERE early) AS BIGINT) AS base, CAST(sum(ms) FILTER (WHERE NOT early) AS BIGINT) AS now FROM e GROUP BY 1)
SELECT user_id, base, now, CAST(floor(base * 1.3::DOUBLE) + 50 AS DOUBLE) AS allowed, coalesce(now <= floor(base * 1.3::DOUBLE) + 50, TRUE) AS passed FROM s WHERE now IS NOT NULL""",
    "output_diff": """WITH w AS (SELECT o_custkey AS k, o_orderpriority FROM orders), h AS (SELECT CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN -o_custkey ELSE o_custkey END AS k, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'),
d AS (SELECT *, 'missing' AS side FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM h) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM h EXCEPT ALL SELECT * FROM w)) SELECT side, k, o_orderpriority, count(*) AS n FROM d GROUP BY ALL""",
    "cost_estimate": "WITH c AS (SELECT role, CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY 1) SELECT role, tokens, round(tokens * 3.0::DOUBLE / 1000000, 6) AS cost, CASE WHEN tokens < 1000 THEN '<1k' WHEN tokens < 100000 THEN '1k-100k' ELSE '>=100k' END AS bucket FROM c",
}
