"""Sharding by sampled splitters.

Size-weighted key samples give quantile boundaries; records are range-partitioned by them, and overfull ranges are
divided again. Records are ordered by (hash of the text, doc_id), so copies of a text lie together. Within the ranges exact
prefix sums of the sizes give each record its place, so shards are near equal in bytes, not only in expectation. Where a
shard ends is decided by the middle of a record, so no shard's end always gains.

A group of copies stays in one shard if it is no larger than the largest single text (which cannot be divided either) or
than BALANCE of a shard; a larger group is divided by doc_id. So a shard is off the mean by that much at most.

Nulls, ties and odd input: a null text has size 1 and counts as an empty text; a null doc_id sorts first; repeated rows
each get a slot; an empty table gives no rows; columns that the operator adds replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_if_null, stored, table
from .ranges import LOWEST, ranges_for, sampled_splitters, with_offsets

SHARDS = 8
#: The part of a shard that its size may be off the mean because copies stay together.
BALANCE = 0.01


def shard_records(docs: DataFrame, shards: int = SHARDS, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (from 0 in each shard, no gaps), grown_shard (null)."""
    text = blank_if_null()
    keys = ("_h", "_id", "_place")  # rows with equal texts and ids can be told apart, so no range is one key
    rows = stored(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("_h"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("_id"),
            F.monotonically_increasing_id().alias("_place"),
        )
    )
    n, total, largest = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(1)), F.coalesce(F.max("size"), F.lit(1))).first()
    placed = with_offsets(rows, keys, "size", sampled_splitters(rows, keys, "size", ranges or ranges_for(n), whole=1))
    placed = stored(placed.select("doc_id", "size", "text_crc32", "_h", "_rank", "_offset"))
    groups = placed.groupBy("_h").agg(F.count(F.lit(1)).alias("_copies"), F.min("_offset").alias("_first"), F.sum("size").alias("_all"))
    groups = groups.where((F.col("_copies") > 1) & (F.col("_all") <= max(largest, BALANCE * total / shards)))
    middle = F.coalesce(F.col("_first") + F.col("_all") / 2, F.col("_offset") + F.col("size") / 2)
    placed = stored(placed.join(groups, "_h", "left").withColumn("shard", F.least(F.floor(middle * F.lit(shards / total)), F.lit(shards - 1)).cast("int")))
    first, n = {}, 0
    counts = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}  # one row a shard
    for s in range(shards):
        first[s], n = n, n + counts.get(s, 0)
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in first.items() for x in kv]), F.col("shard").cast("long"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_rank") - base).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"))


QUERIES = {"op2_sharding": op2_sharding}
ORACLE_SQL: dict[str, str] = {}  # DuckDB has no crc32; tests/llm compares with a brute-force version
