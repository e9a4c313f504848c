"""Git logs as rows: commits, and the files they change, from the text that FORMAT makes.

    git log --name-status --format='%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%cI%x1f%s%x1f%b%x1f'

A record begins with RECORD and its fields end with FIELD, so subjects and bodies may hold anything else, line breaks
included. The text reader splits at RECORD, wherever a file is cut into partitions, so a long log is read by many tasks. A
record with too few fields, or without a hash (a log that was cut off), is dropped; so are lines of files without a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%cI%x1f%s%x1f%b%x1f"
RECORD, FIELD = "\x1e", "\x1f"
# Files of a commit, lines and characters of a body's preview, at most.
MOST_FILES, MOST_LINES, MOST_BODY = 32, 40, 4096


def read(spark: SparkSession, path: str) -> DataFrame:
    """record: the records of all logs under path."""
    return spark.read.option("lineSep", RECORD).text(path).select(F.col("value").alias("record"))


def _fields(records: DataFrame) -> DataFrame:
    f = F.split("record", FIELD)
    at = lambda i: F.regexp_replace(F.get(f, F.lit(i)), "\r", "")
    names = ("sha", "parents", "author", "email", "committed_at", "subject", "body", "changes")
    return records.where(F.size(f) >= 8).select(*[at(i).alias(n) for i, n in enumerate(names)]).where(F.col("sha").rlike("^[0-9a-f]{7,64}$"))


def _cleaned(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^\./", "")


def _changes(text: Column) -> Column:
    """array<struct<change, path, old_path>> of the lines of --name-status; renames and copies have two paths."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.split(x, "\t"))

    def one(p: Column) -> Column:
        kind = F.left(F.trim(p[0]), F.lit(1))
        moved = kind.isin("R", "C")
        path = lambda i: _cleaned(F.get(p, F.lit(i)))
        return F.struct(kind.alias("change"), F.when(moved, path(2)).otherwise(path(1)).alias("path"), F.when(moved, path(1)).alias("old_path"))

    return F.filter(F.transform(parts, one), lambda c: (c["change"] != "") & c["path"].isNotNull() & (c["path"] != ""))


def commits(records: DataFrame) -> DataFrame:
    """sha, parents, author, email, committed_at, subject, body (its preview), truncated, merge, files (how many)."""
    df = _fields(records)
    lines = F.split("body", "\n")
    short = F.trim(F.regexp_replace(F.array_join(F.slice(lines, 1, MOST_LINES), "\n"), r"^\s+|\s+$", ""))
    parents = F.filter(F.split("parents", " +"), lambda p: p != "")
    cut = (F.size(F.split(F.regexp_replace("body", r"\s+$", ""), "\n")) > MOST_LINES) | (F.length(short) > MOST_BODY)
    return df.select("sha", parents.alias("parents"), "author", "email", F.try_to_timestamp("committed_at").alias("committed_at"), "subject", F.left(short, F.lit(MOST_BODY)).alias("body"), cut.alias("truncated"), (F.size(parents) > 1).alias("merge"), F.size(_changes(F.col("changes"))).alias("files"))


def file_changes(records: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """sha, change, path, old_path: files of the commits that change no more than ``most``."""
    found = _fields(records).select("sha", _changes(F.col("changes")).alias("c")).where(F.size("c") <= most)
    return found.select("sha", F.explode("c").alias("c")).select("sha", "c.change", "c.path", "c.old_path")
