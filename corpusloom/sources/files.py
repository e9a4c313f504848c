"""Files of a repository as rows, with ignore rules as one predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex


def inventory(spark: SparkSession, root: str, glob: str = "*", *, content: bool = True) -> DataFrame:
    """path (under root), size, modified and, on request, the text of every file under root that matches the glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    rel = F.substring_index("path", root.rstrip("/").split("://")[-1].removeprefix("file:") + "/", -1)
    out = files.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.decode("content", "UTF-8").alias("body")] if content else []))
    return out.where(~F.col("path").rlike(r"(^|/)(\.git|node_modules|vendor)/"))


def ignore_regexes(rules: str) -> list[tuple[bool, str]]:
    """(negated, regular expression) of each line of an ignore file."""
    out = []
    for line in rules.splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        negated, rule = rule.startswith("!"), rule.lstrip("!")
        anchored, folder = "/" in rule.rstrip("/"), rule.endswith("/")
        body = glob_regex(rule.strip("/"))[1:-1]
        out.append((negated, ("^" if anchored else "(^|/)") + body + ("/" if folder else "(/|$)")))
    return out


def ignored(path: Column | str, rules: str) -> Column:
    """Whether the ignore rules skip a path; the last rule that matches decides."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for negated, regex in ignore_regexes(rules):
        out = F.when(p.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def stale(files: DataFrame, scanned_at: Column) -> DataFrame:
    """One row: whether any file changed after the last scan."""
    return files.agg(F.coalesce(F.max("modified") > scanned_at, F.lit(False)).alias("stale"))
