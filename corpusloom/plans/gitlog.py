"""Git logs: orders written as the text of a log, read back as commits and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import gitlog as G
from ..sources import tables as T


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """record: each order as a record; order lines are its files, returned ones as renames. Orders of a low priority are torn."""
    line = F.when(F.col("change") == "A", F.concat(F.lit("A\t./"), "path")).when(F.col("commit_id") % 3 == 0, F.concat(F.lit("R090\told/"), "path", F.lit("\t"), "path")).otherwise(F.concat(F.lit("M\t"), "path"))
    files = T.commit_files(spark, sf).groupBy("commit_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("files"))
    c = T.commits(spark, sf).join(files, "commit_id", "left")
    sha = lambda k: F.sha2(k.cast("string"), 256)
    k, us = F.col("commit_id"), F.lit(G.FIELD)
    parents = F.when(k % 5 == 0, F.concat_ws(" ", sha(k - 1), sha(k - 2))).otherwise(sha(k - 1))
    body = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), k % 50 + 1), lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit(" of\tit"))), "\n")
    whole = F.concat(sha(k), us, parents, us, F.col("author").cast("string"), us, F.lit("a@x"), us, F.date_format("committed_at", "yyyy-MM-dd"), F.lit("T00:00:00Z"), us, F.col("subject"), us, body, us, F.lit("\n"), F.coalesce("files", F.lit("")), F.lit("\n"))
    return c.select(F.when(F.col("subject").contains("5-low"), F.left(whole, F.lit(100))).otherwise(whole).alias("record"))


def git_log_commits(spark: SparkSession, sf: str) -> DataFrame:
    c = G.commits(_records(spark, sf))
    return c.select("sha", F.size("parents").cast("long").alias("parents"), "author", F.date_format("committed_at", "yyyy-MM-dd").alias("day"), "subject", F.md5("body").alias("body"), "truncated", "merge", F.col("files").cast("long").alias("files"))


def git_log_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the commits that change up to six."""
    return G.file_changes(_records(spark, sf), 6)


QUERIES = {f.__name__: f for f in (git_log_commits, git_log_files)}
_WHOLE = "ok AS (SELECT * FROM commits WHERE NOT contains(subject, '5-low'))"
SQL = {
    "git_log_commits": f"""WITH {T.COMMITS}, {T.COMMIT_FILES}, {_WHOLE}, n AS (SELECT commit_id, count(*) AS n FROM commit_files GROUP BY 1)
SELECT sha256(CAST(commit_id AS VARCHAR)) AS sha, CAST(CASE WHEN commit_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS parents, CAST(author AS VARCHAR) AS author, strftime(committed_at, '%Y-%m-%d') AS day, subject, md5(array_to_string(['line ' || i || ' of' || chr(9) || 'it' FOR i IN range(1, least(commit_id % 50 + 1, 40) + 1)], chr(10))) AS body,
  commit_id % 50 + 1 > 40 AS truncated, commit_id % 5 = 0 AS merge, coalesce(n, 0) AS files FROM ok LEFT JOIN n USING (commit_id)""",
    "git_log_files": f"""WITH {T.COMMITS}, {T.COMMIT_FILES}, {_WHOLE}, small AS (SELECT commit_id FROM commit_files GROUP BY 1 HAVING count(*) <= 6)
SELECT sha256(CAST(commit_id AS VARCHAR)) AS sha, CASE WHEN change = 'A' THEN 'A' WHEN commit_id % 3 = 0 THEN 'R' ELSE 'M' END AS change, path, CASE WHEN change <> 'A' AND commit_id % 3 = 0 THEN 'old/' || path END AS old_path FROM ok JOIN commit_files USING (commit_id) JOIN small USING (commit_id)""",
}
