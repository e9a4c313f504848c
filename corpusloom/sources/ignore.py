"""Ignore rules of a repository as rows: several rule files, nested ones for their folder, the last rule that matches wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import filled

# Rule files, in the order in which their rules follow each other in one folder.
RULE_FILES = (".gitignore", ".git/info/exclude", ".aiignore")
_LITERAL = r"([.+(){}^$|])"


def rule_regex(rule: Column) -> Column:
    """A rule without its leading ! as a regular expression on the path under the rule file's folder."""
    body = F.regexp_replace(F.regexp_replace(rule, r"^/|/$", ""), _LITERAL, r"\\$1")
    for glob, mark in ((r"\*\*/", "\x01"), (r"/\*\*", "\x02"), (r"\*\*", "\x03"), (r"\*", "[^/]*"), (r"\?", "[^/]"), (r"\[!", "[^"), ("\x01", "(?:.*/)?"), ("\x02", "/.*"), ("\x03", ".*")):
        body = F.regexp_replace(body, glob, mark)
    anchored = F.regexp_replace(rule, "/$", "").contains("/")
    return F.concat(F.when(anchored, "^").otherwise("(?:^|/)"), body, F.when(rule.endswith("/"), "/").otherwise("(?:/|$)"))


def rules(files: DataFrame) -> DataFrame:
    """repo, folder, rules (array of struct: place, keeps, regex, rule; the last one first) of rule files (repo, path, body).
    Blank lines and comments are no rules; \\# and \\! begin a rule with that character."""
    which = F.coalesce(*[F.when((F.col("path") == n) | F.col("path").endswith(f"/{n}"), F.lit(i)) for i, n in enumerate(RULE_FILES)])
    named = files.withColumn("which", which).where("which IS NOT NULL")
    folder = F.coalesce(*[F.when(F.col("which") == i, F.regexp_extract("path", rf"^(.*?)/?{n.replace('.', '[.]')}$", 1)) for i, n in enumerate(RULE_FILES)])
    lines = named.select("repo", folder.alias("folder"), "which", F.posexplode(F.split(filled("body"), "\r?\n")).alias("line", "text"))
    lines = lines.withColumn("text", F.regexp_replace("text", r"(?<!\\)\s+$", "")).where("text != '' AND text NOT LIKE '#%'")
    keeps = F.col("text").startswith("!")
    rule = F.regexp_replace(F.when(keeps, F.expr("substring(text, 2)")).otherwise(F.col("text")), r"^\\([#!])", "$1")
    each = lines.select("repo", "folder", F.struct(F.struct("which", "line").alias("place"), keeps.alias("keeps"), rule_regex(rule).alias("regex"), F.col("text").alias("rule")).alias("r")).where("r.rule NOT IN ('!', '/')")
    return each.groupBy("repo", "folder").agg(F.reverse(F.array_sort(F.collect_list("r"))).alias("rules"))


def ignored(files: DataFrame, rule_files: DataFrame) -> DataFrame:
    """repo, path, ignored, rule (the one that decides, null if none matches) for files (repo, path). Rules of a deeper folder
    come after those of the folders above it."""
    up = files.select("repo", "path", F.explode(F.concat(F.array(F.lit("")), paths.ancestors("path"))).alias("folder"))
    inside = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    met = up.join(rules(rule_files), ["repo", "folder"], "left").withColumn("inside", inside)
    last = F.get(F.filter("rules", lambda r: F.rlike(F.col("inside"), r["regex"])), F.lit(0))
    deciding = met.withColumn("last", last).groupBy("repo", "path").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.length("folder"))).alias("last"))
    return deciding.select("repo", "path", F.coalesce(~F.col("last.keeps"), F.lit(False)).alias("ignored"), F.col("last.rule").alias("rule"))
