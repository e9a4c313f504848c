"""Greedy choice under caps, in rounds of joins of rows with their places, instead of one loop over sorted rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder of spark.checkpoint.dir; where that is unset, a session in one process (tests)
    gets a folder of its own, and a cluster an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()


def slot(kind: str, most: int, *key: Column | str) -> Column:
    """A place with room for ``most`` rows."""
    return F.struct(F.to_json(F.struct(F.lit(kind).alias("kind"), *[(F.col(k) if isinstance(k, str) else k).alias(f"k{i}") for i, k in enumerate(key)])).alias("slot"), F.lit(most).alias("most"))


def greedy_capped(rows: DataFrame, order: list[Column], slots: list[Column]) -> DataFrame:
    """The rows that a loop in this order takes, if it takes a row whenever all of the row's slots have room.

    In each round a row is taken if all its slots would have room even with every open row before it, and dropped if a slot
    is full of taken rows before it; so the first open row is always decided. What meets in one task are the rows of one
    slot, of which a full slot keeps only the taken ones. Equal rows follow each other; no rows give no rows.
    """
    names = rows.columns
    state = checkpointed(rows.select(*names, F.array_distinct(F.array(*slots)).alias("_slots"), F.monotonically_increasing_id().alias("_id"), F.lit(None).cast("boolean").alias("_taken")))
    carried = F.struct(*names, "_slots", "_taken")
    before = Window.partitionBy("_slot.slot").orderBy(*order, "_id").rowsBetween(Window.unboundedPreceding, -1)
    while not state.where("_taken IS NULL").isEmpty():
        each = state.withColumn("_slot", F.explode("_slots"))
        each = each.withColumn("_sure", F.count_if("_taken").over(before)).withColumn("_open", F.count_if(F.col("_taken").isNull()).over(before))
        room, most = F.col("_sure") + F.col("_open"), F.col("_slot.most")
        both = each.groupBy("_id").agg(F.bool_and(room < most).alias("_fits"), F.bool_or(F.col("_sure") >= most).alias("_full"), F.first(carried).alias("_row"))
        decided = F.coalesce(F.col("_row._taken"), F.when(F.col("_fits"), True).when(F.col("_full"), False))
        state = checkpointed(both.select(*[F.col(f"_row.`{c}`") for c in names], "_row._slots", "_id", decided.alias("_taken")).where("_taken IS NULL OR _taken"))
    return state.select(*names)


# How many times the rows wanted are looked at first, and how many times more in each next try.
AHEAD, MORE = 3, 16


def greedy_first(rows: DataFrame, order: list[Column], slots: list[Column], most: int, by: str | None = None) -> DataFrame:
    """The first ``most`` rows in this order (of each value of ``by``, whose slots are its own) that greedy_capped takes.

    A row is decided by rows before it alone, so what is taken among the first rows is taken among all. The caps are filled in
    a beginning of the order, and in a longer one while a beginning that is not everything has too few taken rows. Rows that
    are equal in the whole order are taken for each other.
    """
    groups = [] if by is None else [by]
    first = lambda df, n: df.orderBy(*order).limit(n) if by is None else df.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_place") <= n).drop("_place")
    ahead = AHEAD * most
    while True:
        beginning = checkpointed(first(rows, ahead))
        kept = greedy_capped(beginning, order, slots)
        n = beginning.select(*groups, F.lit(1).alias("_seen"), F.lit(0).alias("_kept")).union(kept.select(*groups, F.lit(0), F.lit(1))).groupBy(*groups).agg(F.sum("_seen").alias("seen"), F.sum("_kept").alias("kept"))
        if n.where((F.col("seen") == ahead) & (F.col("kept") < most)).isEmpty():
            return first(kept, most)
        ahead *= MORE
