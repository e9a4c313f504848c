"""Change history: commit filters, co-change pairs and scores, recency, work references, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import STOP_WORDS, filled, tokens

MOST_FILES, MOST_PAIRS = 32, 12
#: A path from which more artifacts than this come is dense: what changes with it says less.
DENSE = 12


def usable_commits(files: DataFrame) -> DataFrame:
    """commit_id, path of commits with at most MOST_FILES files that are not lock files only."""
    distinct = files.select("commit_id", "path").distinct()
    ok = distinct.groupBy("commit_id").agg(F.count("*").alias("n"), F.bool_and(F.col("path").rlike(r"(^|/)(go\.sum|package-lock\.json|[^/]*\.lock)$")).alias("locks")).where((F.col("n") <= MOST_FILES) & ~F.col("locks"))
    return distinct.join(ok.select("commit_id"), "commit_id")


def cochange_pairs(files: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """commit_id, left, right: the first ``most`` pairs of each commit in path order. Commits are bounded in files."""
    f = usable_commits(files)
    a, b = f.alias("a"), f.alias("b")
    pairs = a.join(b, F.col("a.commit_id") == F.col("b.commit_id")).where("a.path < b.path").select("a.commit_id", F.col("a.path").alias("left"), F.col("b.path").alias("right"))
    w = Window.partitionBy("commit_id").orderBy("left", "right")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def cochange_totals(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """left, right, evidence, latest and up to three commits, latest first."""
    joined = pairs.join(commits.select("commit_id", "sha", "committed_at"), "commit_id")
    last = Window.partitionBy("left", "right").orderBy(F.desc("committed_at"), "sha")
    ranked = joined.withColumn("r", F.row_number().over(last))
    return ranked.groupBy("left", "right").agg(
        F.count("*").alias("evidence"),
        F.max("committed_at").alias("latest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "sha")))), lambda s: s["sha"]), ",").alias("examples"),
    )


def history_shape(total: Column, shallow: Column) -> Column:
    """full, single_commit or shallow, from the number of commits that are there and whether older ones are cut off."""
    return F.when(total <= 0, "full").when(total == 1, "single_commit").when(shallow, "shallow").otherwise("full")


def cochange_score(shape: Column, dense: Column, evidence: Column) -> tuple[Column, Column]:
    """Weight and confidence by history shape, density of the paths and repetition."""
    score = lambda other, dense_two, dense_one, two, one: F.when(shape != "full", other).when(dense & (evidence >= 2), dense_two).when(dense, dense_one).when(evidence >= 2, two).otherwise(one)
    return score(0.36, 0.58, 0.42, 0.74, 0.56), score(0.48, 0.72, 0.56, 0.86, 0.64)


def recently_changed(files: DataFrame, commits: DataFrame, most: int = 80, tasks: int | None = None) -> DataFrame:
    """path, changes, latest of the last changed paths. tasks: over how many tasks the changes are dealt by their paths, so
    that each holds few of them while it tells repeated ones apart (None: as the engine does)."""
    changes = files.join(commits.select("commit_id", "committed_at"), "commit_id")
    if tasks is not None:
        changes = changes.repartition(tasks, "path")
    return changes.groupBy("path").agg(F.count_distinct("commit_id").alias("changes"), F.max("committed_at").alias("latest")).orderBy(F.desc("latest"), F.desc("changes"), "path").limit(most)


def plain_subject(subject: Column | str) -> Column:
    """Subject without a conventional-commit prefix."""
    return F.regexp_replace(filled(subject), r"^[a-z]+(\([^)]*\))?!?:\s*", "")


def is_noise(subject: Column | str) -> Column:
    return F.lower(filled(subject)).rlike(r"^(merge |bump |chore\(deps\)|revert |release |wip\b)")


def topic_key(subject: Column | str, path: Column | str) -> Column:
    """First four telling words of the subject, else of the path."""
    telling = lambda c: F.slice(F.filter(tokens(c), lambda t: (F.octet_length(t) >= 3) & ~t.isin(*STOP_WORDS)), 1, 4)
    words = telling(plain_subject(subject))
    return F.array_join(F.when(F.size(words) > 0, words).otherwise(telling(paths.directory(path))), " ")


def topics(commits: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """topic, commits, paths, score, latest: twelve a commit, two a path (ten paths count), one more for tests and sources."""
    joined = commits.where(~is_noise("subject")).join(files, "commit_id").withColumn("topic", topic_key("subject", "path")).where("topic != ''")
    got = joined.groupBy("topic").agg(F.count_distinct("commit_id").alias("commits"), F.count_distinct("path").alias("paths"), F.max("committed_at").alias("latest"), F.max(paths.is_test("path")).alias("tests"), F.max(paths.is_source("path")).alias("sources"))
    score = 12 * F.col("commits") + 2 * F.least(F.col("paths"), F.lit(10)) + F.when(F.col("tests") & F.col("sources"), 1).otherwise(0)
    return got.withColumn("score", score.cast("long")).orderBy(F.desc("score"), "topic").limit(most).select("topic", "commits", "paths", "score", "latest")


def work_references(commits: DataFrame, files: DataFrame) -> DataFrame:
    """ref, commits, paths, families, trust: ticket references of subjects with where they were used."""
    refs = commits.withColumn("ref", F.explode(F.array_distinct(F.regexp_extract_all("subject", F.lit(r"\b[A-Z][A-Z0-9]{1,9}-[0-9]{1,6}\b"), F.lit(0)))))
    used = refs.join(files, "commit_id").groupBy("ref").agg(F.count_distinct("commit_id").alias("commits"), F.count_distinct("path").alias("paths"), F.count_distinct(F.element_at(F.split("path", "/"), 2)).alias("families"))
    trust = F.when((F.col("commits") >= 3) & (F.col("families") >= 2), "trusted").when(F.col("commits") >= 2, "likely").otherwise("weak")
    return used.withColumn("trust", trust)
