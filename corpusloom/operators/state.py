"""State: upserts by content hash, last write wins, scoped replace, short ids, checkpoints, next slice, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_states(current: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """key, state: new, updated, unchanged or missing, by the content hash."""
    c, i = current.select(key, F.col(digest).alias("_c")), incoming.select(key, F.col(digest).alias("_i"))
    state = F.when(F.col("_c").isNull(), "new").when(F.col("_i").isNull(), "missing").when(F.col("_c") == F.col("_i"), "unchanged").otherwise("updated")
    return c.join(i, key, "full").select(key, state.alias("state"))


def last_write(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order (latest first)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def insert_or_ignore(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """current and the incoming rows whose key it lacks (one for each key)."""
    fresh = incoming.dropDuplicates(keys).join(current, keys, "left_anti")
    return current.unionByName(fresh)


def replace_scope(current: DataFrame, incoming: DataFrame, scope: list[str]) -> DataFrame:
    """Rows of current outside the scopes that incoming covers, and all of incoming."""
    return current.join(incoming.select(*scope).distinct(), scope, "left_anti").unionByName(incoming)


def short_ids(df: DataFrame, base: Column, order: list[Column]) -> DataFrame:
    """Adds short_id: the base, with 1, 2, ... appended to later rows of the same base."""
    n = F.row_number().over(Window.partitionBy("_base").orderBy(*order)) - 1
    return df.withColumn("_base", base).withColumn("short_id", F.concat("_base", F.when(n > 0, n.cast("string")).otherwise(""))).drop("_base")


def latest_checkpoints(facts: DataFrame) -> DataFrame:
    """The latest checkpoint of each target, with how many there were."""
    return facts.groupBy("target").agg(F.max(F.struct("created_at", "checkpoint_id", "stage", "score")).alias("m"), F.count("*").alias("checkpoints")).select(
        "target", "m.created_at", "m.checkpoint_id", "m.stage", "m.score", "checkpoints"
    )


def next_items(items: DataFrame, key: str) -> DataFrame:
    """The first open item of each key in order: key, ordinal, text, open, total."""
    return items.groupBy(key).agg(F.min(F.when(~F.col("done"), F.struct("ordinal", "text"))).alias("n"), F.count_if(~F.col("done")).alias("open"), F.count("*").alias("total")).select(key, "n.ordinal", "n.text", "open", "total")


def completeness(required: DataFrame, found: DataFrame, group: str, key: str) -> DataFrame:
    """group, required, present, complete."""
    marks = found.select(group, key).distinct().withColumn("_got", F.lit(1))
    return required.select(group, key).distinct().join(marks, [group, key], "left").groupBy(group).agg(F.count("*").alias("required"), F.count("_got").alias("present"), F.bool_and(F.col("_got").isNotNull()).alias("complete"))
