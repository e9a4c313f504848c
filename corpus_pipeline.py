"""Corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding of the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of
documents (the last one returns the shards). Between stages the rows are written as Parquet in the shared folder and read
again, so a lost executor costs the work of one stage at most.

Nulls, ties and odd input: near-dedup and decontamination decide about rows and texts, not ids: the one gives each row a
key of its own first, the other takes the text's digest, so rows without doc_id, or with one that repeats, are judged by their own texts. Of a group of near copies the row of least
doc_id stays (null last, then the first stored). Null texts and texts without letters go in the first stage. Columns
of documents other than those a stage needs are set aside under other names meanwhile, so none can clash. An empty table
passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, table
from corpusloom.llm.decontaminate import find_leaks
from corpusloom.llm.langid import fit_model, identify
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.nearest import near_duplicates
from corpusloom.llm.sharding import shard_records

#: Documents whose best language is less likely than this go (little over chance for four languages), as do those without letters.
LEAST_LANGUAGE_SCORE = 0.3


def _aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but those needed renamed, and the columns that undo it."""
    names = {c: c if c in needed else f"_aside{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, row): the rows of docs, stored with a key of their own."""
    return stored(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = _aside(docs, "doc_id", "text", "lang")
    found = identify(rows, fit_model(rows), keep=rows.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*back)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    rows = _keyed(docs)
    classes = near_duplicates(rows.select(F.col("key").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("key"), "class_id")
    copies = stored(classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class_id"))
    several = stored(classes.join(copies, "class_id").join(rows.select("key", "row.doc_id"), "key").select("class_id", "key", "doc_id"))
    stays = several.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")).select(F.col("first.key").alias("key"))
    go = stored(several.select("key").join(stays, "key", "left_anti"))
    return rows.join(go, "key", "left_anti").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text says whether it leaks, so texts are looked up by their digests; null texts stay."""
    rows = docs.select(F.md5("text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    leaks = stored(find_leaks(rows.select(F.col("key").alias("doc_id"), "row.text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct())
    return rows.join(leaks, "key", "left_anti").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows, back = _aside(docs, "doc_id", "text", "source")
    mixed = mix_sources(rows).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*back)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_records(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
ORACLE_SQL = None  # SQL cannot express the stages; tests/llm/test_pipeline.py compares each with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
