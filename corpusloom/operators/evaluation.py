"""Retrieval-quality evaluation: recall, graded precision, hits, budgets, percentiles, confusion, regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a retrieved document is worth by its grade.
GRADES = {"must": 1.0, "helpful": 0.6, "background": 0.3, "hard_negative": -1.0}


def graded(retrieved: DataFrame, relevance: DataFrame) -> DataFrame:
    """retrieved (case_id, doc, rank) with grade ('none' if unknown) and worth."""
    worth = F.lit(0.0)
    for k, v in GRADES.items():
        worth = F.when(F.col("grade") == k, F.lit(v)).otherwise(worth)
    return retrieved.join(relevance, ["case_id", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit("none"))).withColumn("worth", worth)


def case_metrics(got: DataFrame, relevance: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row a case: recall of musts, precision, graded and penalised precision, rank of the first must, hits."""
    need = relevance.groupBy("case_id").agg(F.count_if(F.col("grade") == "must").alias("must"))
    per = got.groupBy("case_id").agg(
        F.count("*").alias("retrieved"),
        F.count_if(F.col("grade") == "must").alias("must_found"),
        F.count_if(F.col("grade").isin("must", "helpful", "background")).alias("useful"),
        F.sum(F.greatest("worth", F.lit(0.0))).alias("gain"),
        F.sum("worth").alias("net"),
        F.min(F.when(F.col("grade") == "must", F.col("rank"))).alias("first_must"),
    )
    return need.join(per, "case_id", "left").select(
        "case_id",
        F.coalesce("retrieved", F.lit(0).cast("long")).alias("retrieved"),
        F.round(F.coalesce("must_found", F.lit(0)) / F.when(F.col("must") > 0, F.col("must")), 6).alias("recall"),
        F.round(F.col("useful") / F.col("retrieved"), 6).alias("precision"),
        F.round(F.col("gain") / F.col("retrieved"), 6).alias("graded_precision"),
        F.round(F.greatest(F.col("net"), F.lit(0.0)) / F.col("retrieved"), 6).alias("penalized_precision"),
        "first_must",
        *[F.coalesce(F.col("first_must") <= k, F.lit(False)).alias(f"hit_{k}") for k in at],
    )


def nearest_rank(value: Column, p: float) -> Column:
    return F.percentile_disc(p).within_group(value) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")


def timing_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """total, p50, p95 and maximum by the nearest-rank rule."""
    return df.groupBy(group).agg(
        F.sum(value).alias("total"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.max(value).alias("most"), F.count("*").alias("n")
    )


def regression_gate(base: DataFrame, now: DataFrame, key: str, value: str, ratio: float, slack: float) -> DataFrame:
    """key, base, now, allowed, passed; a case without a base passes."""
    b, n = base.select(key, F.col(value).alias("base")), now.select(key, F.col(value).alias("now"))
    allowed = F.floor(F.col("base") * ratio) + slack
    return n.join(b, key, "left").select(key, "base", "now", allowed.cast("double").alias("allowed"), F.coalesce(F.col("now") <= allowed, F.lit(True)).alias("passed"))


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_quality(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """label, precision, recall over one exploded pass (no join)."""
    both = df.select(F.explode(F.array(F.struct(F.col(expected).alias("label"), F.lit(1).alias("e"), F.lit(0).alias("p"), (F.col(expected) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("e"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    return both.groupBy("label").agg(F.sum("e").alias("ne"), F.sum("p").alias("np"), F.sum("hit").alias("nh")).select(
        "label", F.round(F.col("nh") / F.when(F.col("np") > 0, F.col("np")), 6).alias("precision"), F.round(F.col("nh") / F.when(F.col("ne") > 0, F.col("ne")), 6).alias("recall")
    )


def token_reduction(used: Column, whole: Column) -> Column:
    return F.round(1 - used / F.when(whole > 0, whole), 6)
