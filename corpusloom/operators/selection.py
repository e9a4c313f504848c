"""Selection under caps and quotas, matching of expected with found rows, labels of headings, folders and counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Mentions that each artifact keeps, and mentions of a repository.
LEAST_MENTIONS, MOST_MENTIONS = 8, 60_000
# Places of each source role, and of all together.
SOURCE_QUOTAS = {"implementation": 1550, "test": 800, "test_doc_example": 100, "fixture": 50}
MOST_SOURCES = 2500
# Scores of a strong and of a weak shared concept, and of its idf.
STRONG, WEAK, IDF = 4.0, 1.0, 0.2
# Folders that say nothing about what lies in them.
GENERIC_FOLDERS = (
    "plans", "specs", "docs", ".cursor", "openspec", "changes", "adr", "adrs", "_bmad-output", "planning-artifacts",
    "implementation-artifacts", "checklists", "contracts", ".specify",
)
# The first label of which a word stands in the heading.
SECTION_KINDS = {
    "decision": ("decision", "rationale", "consequences"),
    "requirement": ("requirement", "acceptance", "criteria"),
    "task": ("task", "todo", "next step"),
    "design": ("design", "architecture"),
    "risk": ("risk", "open question"),
}
SECTION_ROLES = {
    "decision": ("decision outcome", "decision"),
    "context": ("context", "background", "problem"),
    "consequences": ("consequence", "consequences", "impact"),
    "product": ("goal", "non-goal", "user outcome", "users", "personas"),
    "requirements": ("requirement", "acceptance criteria", "success metric"),
    "risk": ("risk", "drawback"),
    "open_questions": ("open question", "unresolved"),
    "tasks": ("task", "implementation", "plan", "todo"),
    "rollout": ("rollout", "migration"),
    "deferred": ("deferred", "out of scope", "non-goals"),
    "alternatives": ("option", "alternative"),
    "proposal": ("motivation", "proposal", "design", "summary", "abstract"),
}
# Upper ends of the buckets of counts, and of those of milliseconds (exclusive).
COUNT_BUCKETS = {0: "0", 10: "1-10", 50: "11-50", 100: "51-100", 500: "101-500"}
DURATION_BUCKETS = {100: "<100ms", 500: "100-499ms", 1000: "500-999ms", 5000: "1-4s", 30_000: "5-29s", 120_000: "30-119s"}
#: A line or a range of lines at the end of a path in lower case.
LINES = "#l[0-9]+(-l[0-9]+)?$"


def pair_score(strong: Column, weak: Column, idf: Column) -> Column:
    return STRONG * strong + WEAK * weak + IDF * idf


def two_tier(df: DataFrame, group: str, item: str, order: list[Column], least: int = LEAST_MENTIONS, most: int = MOST_MENTIONS, salts: int = 32) -> DataFrame:
    """Of each group at most ``most`` rows: first the best ``least`` of every item, then the best of the others. The best
    of each salt are chosen first, so no task ranks more than ``salts * most`` rows of a large group."""
    ranked = df.withColumn("_extra", F.row_number().over(Window.partitionBy(group, item).orderBy(*order)) > least)
    by = [F.col("_extra"), *order]
    for keys in ([F.col(group), F.pmod(F.xxhash64(item), F.lit(salts))], [F.col(group)]):
        ranked = ranked.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("_place") <= most)
    return ranked.drop("_extra", "_place")


def quota_refill(df: DataFrame, role: str, key: str, order: list[Column], quotas: Mapping[str, int] = SOURCE_QUOTAS, most: int = MOST_SOURCES) -> DataFrame:
    """The best of each role up to its quota; places that are left go to the best of all others, up to ``most``. Adds
    refill. Each choice is an ordered limit, so no task sorts a role; ``key`` is unique and ends the order."""
    first = df.limit(0).select(key)
    for name, n in quotas.items():
        first = first.unionByName(df.where(F.col(role) == name).orderBy(*order).limit(n).select(key))
    marked = df.join(first.withColumn("_quota", F.lit(True)), key, "left").withColumn("refill", F.col("_quota").isNull()).drop("_quota")
    return marked.orderBy("refill", *order).limit(most)


def set_recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row: recall of bundles and of children with their role, children a bundle; both sides (bundle, child, role)."""
    e, f = (x.groupBy("bundle", "child").agg(F.min("role").alias(n)) for x, n in ((expected, "want"), (found, "have")))
    per = e.join(f, ["bundle", "child"], "full").groupBy("bundle").agg(
        F.count("want").alias("want"), F.count("have").alias("have"), F.count_if(F.col("want") == F.col("have")).alias("same")
    )
    n = per.agg(
        F.count_if(F.col("want") > 0).alias("expected_bundles"), F.count_if(F.col("have") > 0).alias("found_bundles"),
        F.count_if((F.col("want") > 0) & (F.col("have") > 0)).alias("both"),
        F.coalesce(F.sum("want"), F.lit(0)).alias("expected_children"), F.coalesce(F.sum("have"), F.lit(0)).alias("found_children"), F.coalesce(F.sum("same"), F.lit(0)).alias("same"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)), 6)

    return n.select(
        "expected_bundles", "found_bundles", "expected_children", "found_children", ratio("both", "expected_bundles").alias("bundle_recall"),
        ratio("same", "expected_children").alias("child_role_recall"), ratio("found_children", "found_bundles").alias("duplicate_pressure"),
    )


def identity_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a, b) of paths that are equal, or equal without their lines where one of them names none; case is ignored."""
    sides = []
    for df, name in ((a, "a"), (b, "b")):
        norm = F.lower(F.trim(F.replace(F.col("path"), F.lit("\\"), F.lit("/"))))
        side = df.select(F.col("path").alias(name), norm.alias(f"{name}_norm"), F.regexp_replace(norm, LINES, "").alias("base"))
        sides.append(side.where(F.col("base") != ""))
    lines = F.col("a_norm").rlike(LINES) & F.col("b_norm").rlike(LINES)
    return sides[0].join(sides[1], "base").where((F.col("a_norm") == F.col("b_norm")) | ~lines).select("a", "b")


def directory_tag(path: str) -> Column:
    """The first folder that is neither generic nor a numbered feature folder; none: empty."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    telling = F.filter(folders, lambda p: (p != "") & (p != ".") & ~p.isin(*GENERIC_FOLDERS) & ~p.rlike("^[0-9]{3}-."))
    return F.coalesce(F.get(telling, F.lit(0)), F.lit(""))


def heading_label(heading: Column, labels: Mapping[str, tuple[str, ...]]) -> Column:
    """The first label of which a word stands in the heading; none: empty."""
    low, out = F.lower(heading), F.lit("")
    for label, some in reversed(labels.items()):
        out = F.when(F.greatest(F.lit(False), *[F.contains(low, F.lit(w)) for w in some]), label).otherwise(out)
    return out


def count_bucket(n: Column) -> Column:
    out = F.lit("501+")
    for top, name in reversed(COUNT_BUCKETS.items()):
        out = F.when(n <= top, name).otherwise(out)
    return out


def duration_bucket(ms: Column) -> Column:
    out = F.concat(F.floor(ms / 1000).cast("string"), F.lit("s+"))
    for top, name in reversed(DURATION_BUCKETS.items()):
        out = F.when(ms < top, name).otherwise(out)
    return out


def point_updates(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the values of updates (one row a key) where these are not null; keys without a row are ignored."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return rows.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def numbered(df: DataFrame, pos: str, name: str, width: int = 65_536) -> DataFrame:
    """Adds the row's number by the whole number pos (from 1, pos is unique): numbered within ranges of ``width``
    positions, after the counts of the ranges before. Only one row a range meets in one task."""
    rows = df.withColumn("_range", F.floor(F.col(pos) / width))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(pos))
    return rows.join(starts, "_range").withColumn(name, (F.col("_start") + place).cast("long")).drop("_range", "_start")


def histograms(df: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """dimension, value, n: the counts of all dimensions from one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(c.cast("string"), F.lit("")).alias("value")) for d, c in dimensions.items()]))
    return df.select(each.alias("e")).groupBy("e.dimension", "e.value").agg(F.count("*").alias("n"))


def link_map(links: DataFrame, source: str) -> DataFrame:
    """source and links: a map from link_<type> to its distinct targets, one a line; blank types and targets are left out."""
    clean = links.select(source, F.trim("type").alias("type"), F.trim("target").alias("target")).where("type != '' AND target != ''")
    each = clean.groupBy(source, "type").agg(F.array_join(F.array_sort(F.collect_set("target")), "\n").alias("targets"))
    entry = F.struct(F.concat(F.lit("link_"), F.replace("type", F.lit("-"), F.lit("_"))), "targets")
    return each.groupBy(source).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("links"))
