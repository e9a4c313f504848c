"""Context packs: roles, budgets, summaries, and first-fit packing under a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many items of each role a pack shows.
ROLE_BUDGETS = {"primary": 3, "source": 6, "test": 5, "plan": 3, "decision": 3, "background": 3, "noise": 5}


def role_case(kind: Column, path_class: Column, status: Column) -> Column:
    return (
        F.when((status == "superseded") | path_class.isin("noise", "archive"), "noise").when(path_class == "test", "test").when(path_class == "source", "source").when(kind == "decision", "decision").when(kind == "requirements", "primary").when(kind == "plan", "plan").otherwise("background")
    )


def budgeted(ranked: DataFrame, group: str, budgets: dict[str, int] = ROLE_BUDGETS) -> DataFrame:
    """Ranked rows (group, role, rank) with the place in their role and whether it is within budget."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col("role")), F.lit(0))
    w = Window.partitionBy(group, "role").orderBy("rank")
    return ranked.withColumn("place", F.row_number().over(w).cast("long")).withColumn("shown", F.col("place") <= limit)


def pack_summary(rows: DataFrame, group: str) -> DataFrame:
    """group, items, shown, roles, overflow, has_test, has_source."""
    return rows.groupBy(group).agg(
        F.count("*").alias("items"), F.count_if("shown").alias("shown"), F.count_distinct("role").alias("roles"), F.count_if(~F.col("shown")).alias("overflow"), F.max(F.col("role") == "test").alias("has_test"), F.max(F.col("role") == "source").alias("has_source")
    )


def first_fit(ranked: DataFrame, group: str, size: str, budget: int) -> DataFrame:
    """Greedy packing in rank order: a row is taken if it still fits; if none fits, the first row is taken.

    What is left of the budget depends on all rows before, so a group is a stream in rank order; one number is remembered.
    """
    cols = [group, "rank", size]
    ordered = ranked.select(*cols).withColumn("_first", F.col("rank") == F.min("rank").over(Window.partitionBy(group))).withColumn("_fits", F.min(size).over(Window.partitionBy(group)) <= budget)
    ordered = ordered.repartition(group).sortWithinPartitions(group, "rank")

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left = None, 0
        for f in frames:
            keep = []
            for g, n, first, fits in zip(f[group], f[size], f["_first"], f["_fits"], strict=True):
                if g != now:
                    now, left = g, budget
                ok = n <= left if fits else bool(first)
                left -= n if ok else 0
                keep.append(ok)
            yield f.loc[keep, cols]

    return ordered.mapInPandas(pick, ranked.select(*cols).schema)


def variant_collapsed(rows: DataFrame, fingerprint: Column, order: list[Column], keep: Column) -> DataFrame:
    """Best row of each fingerprint, with how many others it stands for; rows to keep stand for themselves."""
    w = Window.partitionBy("_f").orderBy(*order)
    marked = rows.withColumn("_f", F.when(keep, F.concat(F.lit("\0"), F.col("path"))).otherwise(fingerprint))
    return marked.withColumn("_r", F.row_number().over(w)).withColumn("collapsed", (F.count("*").over(Window.partitionBy("_f")) - 1).cast("long")).where("_r = 1").drop("_f", "_r")
