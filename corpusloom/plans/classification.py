"""Classification with rule models, and admission scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import Model, Rule, classified
from ..operators.evaluation import class_quality, confusion
from ..sources import tables as T

MODELS = [
    Model("decision_record", prior=(Rule(0.45, path_glob=("docs/fr/**",)),), positive=(Rule(0.2, body_contains=("licen",)), Rule(0.15, least_bytes=2000)), negative=(Rule(0.3, body_any=("idiot", "stupid")),)),
    Model("plan", prior=(Rule(0.4, path_glob=("docs/en/**",)),), positive=(Rule(0.2, title_contains=("the",)), Rule(0.1, body_regex="\\d{4}")), negative=(Rule(0.25, body_contains=("!!",)),), families={"short": (Rule(0.1, body_contains=("tion",)),), "long": (Rule(0.2, least_bytes=4000),)}),
    Model("requirements", prior=(Rule(0.5, path_glob=("docs/de/**", "docs/es/**")),), positive=(Rule(0.2, kind=("requirements",)), Rule(0.1, least_bytes=500)), negative=(Rule(0.1, body_contains=("$$$",)),)),
]


def classify_rules(spark: SparkSession, sf: str) -> DataFrame:
    return classified(T.artifacts(spark, sf), MODELS, "artifact_id")


def classifier_confusion(spark: SparkSession, sf: str) -> DataFrame:
    a = T.artifacts(spark, sf)
    c = classified(a, MODELS, "artifact_id").join(a.select("artifact_id", "kind"), "artifact_id")
    return confusion(c, "kind", "classifier")


def classifier_quality(spark: SparkSession, sf: str) -> DataFrame:
    a = T.artifacts(spark, sf)
    expected = F.when(F.col("kind") == "plan", "plan").when(F.col("kind") == "decision", "decision_record").otherwise("requirements")
    c = classified(a, MODELS, "artifact_id").join(a.select("artifact_id", expected.alias("expected")), "artifact_id")
    return class_quality(c, "expected", "classifier")


def intent_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Path and heading tokens joined with a table of weights, summed, and admitted from a threshold."""
    weights = spark.createDataFrame([("en", 0.5), ("src1", 0.4), ("src2", 0.3), ("the", 0.2), ("and", 0.1), ("de", 0.35)], "token string, w double")
    a = T.artifacts(spark, sf)
    tok = a.select("artifact_id", F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", F.regexp_replace("path", "[/.]", " "), "title")), " "))).alias("token"))
    return tok.join(weights, "token").groupBy("artifact_id").agg(F.round(F.sum("w"), 6).alias("score"), F.count("*").alias("signals")).where("score >= 0.5")


def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    a = T.artifacts(spark, sf)
    phase = F.when(F.col("status") == "superseded", "retired").when(F.col("status") == "accepted", "settled").otherwise("open")
    stale = (F.col("status") == "superseded") | F.lower("body").contains("licen")
    return a.groupBy(phase.alias("lifecycle"), "kind").agg(F.count("*").alias("n"), F.count_if(stale).alias("stale"))


QUERIES = {f.__name__: f for f in (classify_rules, classifier_confusion, classifier_quality, intent_admission, lifecycle)}

_CLASS = f"""{T.ARTIFACTS}, m AS (SELECT artifact_id, kind,
round(least(greatest(0.0 + CASE WHEN regexp_matches(lower(path), '^docs/fr/.*$') THEN 0.45 ELSE 0.0 END + CASE WHEN contains(lower(body), 'licen') THEN 0.2 ELSE 0.0 END + CASE WHEN strlen(body) >= 2000 THEN 0.15 ELSE 0.0 END
  + CASE WHEN contains(lower(body), 'idiot') OR contains(lower(body), 'stupid') THEN -0.3 ELSE 0.0 END, 0.0), 1.0)::DOUBLE, 3) AS s1,
round(least(greatest(0.0 + CASE WHEN regexp_matches(lower(path), '^docs/en/.*$') THEN 0.4 ELSE 0.0 END + CASE WHEN contains(lower(title), 'the') THEN 0.2 ELSE 0.0 END + CASE WHEN regexp_matches(lower(body), '\\d{{4}}') THEN 0.1 ELSE 0.0 END
  + CASE WHEN contains(lower(body), '!!') THEN -0.25 ELSE 0.0 END + greatest(CASE WHEN contains(lower(body), 'tion') THEN 0.1 ELSE 0.0 END, CASE WHEN strlen(body) >= 4000 THEN 0.2 ELSE 0.0 END), 0.0), 1.0)::DOUBLE, 3) AS s2,
round(least(greatest(0.0 + CASE WHEN regexp_matches(lower(path), '^docs/(de|es)/.*$') THEN 0.5 ELSE 0.0 END + CASE WHEN kind = 'requirements' THEN 0.2 ELSE 0.0 END + CASE WHEN strlen(body) >= 500 THEN 0.1 ELSE 0.0 END
  + CASE WHEN contains(lower(body), '$$$') THEN -0.1 ELSE 0.0 END, 0.0), 1.0)::DOUBLE, 3) AS s3 FROM artifacts),
r AS (SELECT artifact_id, kind, list_sort([(-s1, 'decision_record'), (-s2, 'plan'), (-s3, 'requirements')]) AS r FROM m),
c AS (SELECT artifact_id, kind, CASE WHEN -(r[1][1]) < 0.35 THEN 'none' ELSE r[1][2] END AS classifier, -(r[1][1]) + 0.0::DOUBLE AS confidence, r[2][2] AS second,
  -(r[1][1]) < 0.55 OR (-(r[1][1]) < 0.75 AND round(r[2][1] - r[1][1], 3) < 0.15) AS ambiguous, -(r[1][1]) >= 0.35 AS indexed FROM r)"""
SQL = {
    "classify_rules": f"WITH {_CLASS} SELECT artifact_id, classifier, confidence, second, ambiguous, indexed FROM c",
    "classifier_confusion": f"WITH {_CLASS} SELECT kind AS expected, classifier AS predicted, count(*) AS n FROM c GROUP BY ALL",
    "classifier_quality": f"""WITH {_CLASS}, e AS (SELECT CASE kind WHEN 'plan' THEN 'plan' WHEN 'decision' THEN 'decision_record' ELSE 'requirements' END AS expected, classifier FROM c), l AS (SELECT expected AS label FROM e UNION SELECT classifier FROM e)
SELECT label, round(count(*) FILTER (WHERE expected = label AND classifier = label) / nullif(count(*) FILTER (WHERE classifier = label), 0), 6) AS precision, round(count(*) FILTER (WHERE expected = label AND classifier = label) / nullif(count(*) FILTER (WHERE expected = label), 0), 6) AS recall FROM l, e GROUP BY label""",
    "intent_admission": f"""WITH {T.ARTIFACTS}, w(token, w) AS (VALUES ('en', 0.5::DOUBLE), ('src1', 0.4), ('src2', 0.3), ('the', 0.2), ('and', 0.1), ('de', 0.35)),
t AS (SELECT artifact_id, unnest(list_distinct(string_split(lower(regexp_replace(path, '[/.]', ' ', 'g') || ' ' || title), ' '))) AS token FROM artifacts), s AS (SELECT artifact_id, round(sum(w), 6) AS score, count(*) AS signals FROM t JOIN w USING (token) GROUP BY 1) SELECT * FROM s WHERE score >= 0.5""",
    "lifecycle": f"WITH {T.ARTIFACTS} SELECT CASE status WHEN 'superseded' THEN 'retired' WHEN 'accepted' THEN 'settled' ELSE 'open' END AS lifecycle, kind, count(*) AS n, count(*) FILTER (WHERE status = 'superseded' OR contains(lower(body), 'licen')) AS stale FROM artifacts GROUP BY ALL",
}
