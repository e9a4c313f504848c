"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected target / source_size times. Within a source the documents are ordered by size (ties
by a hash of doc_id); the expected copies are added up along that order, one random offset of the source is added, and a
document is emitted once for each integer boundary that its step crosses. Ordering by size makes every stretch of sizes
come out in proportion, so the words taken stay near the target even where a few documents are very long.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share 150 % of all sizes; a target stops at twice
its source's size and the excess goes to the others by weight until none is above (solved in closed form: the water level).

Nulls, ties and odd input: a null text has size 0; a null source is a source of its own; a source without words takes
nothing; repeated rows are drawn one by one; an empty table gives no rows; columns that the operator adds replace input
columns of the same name. The result depends on the rows and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, blank_if_null, stored, table
from .ranges import LOWEST, ranges_for, sampled_splitters, with_offsets

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: Hex digits of an md5 as a number; the SQL below computes the same.
_HEX = 15


def _number(value: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(value), 1, _HEX), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row a source: source, _source (its number), source_size, target, _u (its random offset), _first (rows before)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("_ratio", "_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_source") % len(weights) + 1).cast("int"))
    out = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_source", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumn("_first", F.sum("_rows").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows"))
        .withColumn("_weight", weight.cast("long"))
        .withColumn("_cap", F.col("source_size") * cap)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_below", F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap"))
        .withColumn("_rest", F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(Window.partitionBy(F.lit(1))))
        # the level that would hold if this source and all after it stayed below their caps
        .withColumn("_level", (F.col("_all") * F.lit(share) - F.col("_below")) / F.col("_rest"))
    )
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(Window.partitionBy(F.lit(1)))
    u = _number(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("source"), F.lit("")), F.col("_source").cast("string"))) / F.lit(float(16**_HEX))
    return (
        out.withColumn("_lambda", level)
        .withColumn("target", F.when(F.col("_ratio") < F.col("_lambda"), F.col("_cap").cast("double")).otherwise(F.coalesce(F.col("_lambda"), F.lit(0.0)) * F.col("_weight")))
        .select("source", "_source", "source_size", "target", u.alias("_u"), "_first")
    )


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, ranges: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, source and any other columns) with size, source_size, target, copies and taken for each row.

    ``copies`` says how often the mix holds the row; ``taken`` is copies times size. keep: the input columns to return
    (all by default); without text among them, only ids and sizes are shuffled.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    keep = docs.columns if keep is None else keep
    hashed = _number(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    base = docs.select(
        *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
        F.col("source"),
        F.regexp_count(blank_if_null(), F.lit(WORD)).cast("long").alias("size"),
        hashed.alias("_h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("_id"),
        F.xxhash64("text").alias("_t"),
    )
    keys = ("_source", "size", "_h", "_id", "_t")
    if "text" not in keep:  # ids and sizes are stored, and their place there tells equal rows apart; texts are not stored again
        base, keys = stored(base.withColumn("_place", F.monotonically_increasing_id())), (*keys, "_place")
    slim = base if "text" not in keep else stored(base.select("source", "size", "_h", "_id", "_t"))
    targets = stored(source_targets(slim, weights, share, cap, seed))
    keyed = lambda df: df.join(targets.withColumnRenamed("source", "_name"), F.col("source").eqNullSafe(F.col("_name"))).drop("_name").withColumn("_one", F.lit(1).cast("long"))
    splitters = sampled_splitters(keyed(slim), keys, "_one", ranges or ranges_for(slim.count()))
    ranked = with_offsets(keyed(base), keys, "_one", splitters)
    upto = lambda i: F.floor(i * F.col("_per") + F.col("_u"))
    return (
        ranked.withColumn("_per", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("_i", F.col("_rank") - F.col("_first"))
        .withColumn("copies", (upto(F.col("_i") + 1) - upto(F.col("_i"))).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", "copies", "taken")
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE_SQL = {
    "op10_mixing": rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][(k % 3 + 1)::INT]::BIGINT AS weight, source_size * 2 AS cap FROM src),
lv AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () AS total,
         sum(cap) OVER (ORDER BY cap / weight, k ROWS UNBOUNDED PRECEDING) - cap AS below,
         sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
lm AS (SELECT max((total::DOUBLE * 1.5 - below::DOUBLE) / rest::DOUBLE) FILTER (WHERE (total::DOUBLE * 1.5 - below::DOUBLE) / rest::DOUBLE <= ratio) AS lvl FROM lv),
t AS (SELECT source, k, source_size, CASE WHEN ratio < lvl THEN cap::DOUBLE ELSE coalesce(lvl, 0.0) * weight::DOUBLE END AS target,
        ('0x' || substr(md5('{SEED}|' || coalesce(source, '') || '|' || k), 1, {_HEX}))::BIGINT / {float(16**_HEX)!r} AS u FROM lv, lm),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS per,
        row_number() OVER (PARTITION BY t.k ORDER BY d.size, ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '')), 1, {_HEX}))::BIGINT, d.doc_id NULLS FIRST) - 1 AS i
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor((i + 1) * per + u) - floor(i * per + u)) * size)::BIGINT AS taken,
       (floor((i + 1) * per + u) - floor(i * per + u))::BIGINT AS copies
FROM r"""
}
QUERIES = {"op10_mixing": op10_mixing}
