"""Keeps an artifact table current from a stream of files, and counts checkpoints in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..operators.state import last_write


def checkpoint_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """stage, window start and count of checkpoints by event time; later rows than ``late`` are dropped."""
    return stream.withWatermark("created_at", late).groupBy(F.window("created_at", width), "stage").agg(F.count("*").alias("n"), F.sum("score").alias("score")).select("stage", F.col("window.start").alias("start"), "n", "score")


def index_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Upserts a stream of (path, body, seen_at) into versions of a Parquet table under ``folder``.

    A batch writes version batch_id + 1 from version batch_id, so a batch that is run again gives the same files.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = last_write(batch.withColumn("digest", content_hash("body")), ["path"], [F.desc("seen_at"), F.desc("digest")])
        if batch_id:
            old = batch.sparkSession.read.parquet(f"{folder}/v={batch_id}").select(*fresh.columns, "revision")
            known = old.select("path", F.col("digest").alias("_old"), F.col("revision").alias("_rev"))
            fresh = fresh.join(known, "path", "left").withColumn("revision", F.coalesce(F.col("_rev") + (F.col("_old") != F.col("digest")).cast("long"), F.lit(1).cast("long"))).drop("_old", "_rev")
            fresh = fresh.unionByName(old.join(fresh.select("path"), "path", "left_anti"))
        else:
            fresh = fresh.withColumn("revision", F.lit(1).cast("long"))
        fresh.write.mode("overwrite").parquet(f"{folder}/v={batch_id + 1}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
