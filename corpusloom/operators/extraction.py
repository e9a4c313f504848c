"""Extraction from markdown bodies: lines, fences, sections, todos, criteria, references, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, filled, token_estimate

HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"
LOOSE_HEADING = r"^(#{1,6})\s*(.*?)\s*$"
CHECK = r"^\s*[-*+] \[([ xX])\] (.+?)\s*$"
FENCE = r"^\s*(```|~~~)"


def lines(docs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, line_no (from 1), line; \\r\\n and \\r count as line ends."""
    text = F.regexp_replace(filled(body), r"\r\n?", "\n")
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("long"))


def with_fences(rows: DataFrame, key: str) -> DataFrame:
    """Adds is_fence and in_fence (between an opening fence and its closing one)."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("is_fence", F.col("line").rlike(FENCE))
    return marked.withColumn("in_fence", (F.sum(F.col("is_fence").cast("int")).over(w) % 2 == 1) & ~F.col("is_fence"))


def sections(docs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, ordinal, depth, title, heading_path, start_line, end_line, text, tokens: one row a heading outside fences."""
    rows = with_fences(lines(docs, key, body), key)
    level = F.when(~F.col("is_fence") & ~F.col("in_fence") & F.col("line").rlike(HEADING), F.length(F.regexp_extract("line", HEADING, 1))).otherwise(0)
    rows = rows.withColumn("depth", level.cast("long"))
    by_line = Window.partitionBy(key).orderBy("line_no")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("ordinal", F.sum((F.col("depth") > 0).cast("long")).over(so_far))
    one = rows.where("ordinal > 0").groupBy(key, "ordinal").agg(
        F.max("depth").alias("depth"),
        F.max(F.when(F.col("depth") > 0, F.regexp_extract("line", HEADING, 2))).alias("title"),
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("text"),
    )
    # a heading's path: for each level above its own, the last heading of that level with none shallower after it
    up = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(1, 7):
        one = one.withColumn(f"_t{k}", F.last(F.when(F.col("depth") == k, F.struct("ordinal", "title")), True).over(up))
    for k in range(1, 7):
        shallower = [F.coalesce(F.col(f"_t{j}.ordinal"), F.lit(0)) for j in range(1, k)]
        kept = (F.col("depth") >= k) & F.col(f"_t{k}").isNotNull()
        if shallower:
            kept = kept & (F.col(f"_t{k}.ordinal") > (F.greatest(*shallower) if len(shallower) > 1 else shallower[0]))
        one = one.withColumn(f"_p{k}", F.when(kept, F.col(f"_t{k}.title")))
    return one.select(key, "ordinal", "depth", "title", F.concat_ws(" > ", *[F.col(f"_p{k}") for k in range(1, 7)]).alias("heading_path"), "start_line", "end_line", "text", token_estimate("text").alias("tokens"))


def criteria_kind(heading: Column) -> Column:
    h = F.lower(heading)
    return F.when(h.contains("okr") | h.contains("key result"), "okr").when(h.contains("acceptance"), "acceptance").when(h.contains("success"), "success")


def checklist(docs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, line_no, done, text, criteria_kind (null for todos), ordinal within its kind; fences and quotes do not count."""
    rows = with_fences(lines(docs, key, body), key)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.when(~F.col("is_fence") & ~F.col("in_fence") & F.col("line").rlike(LOOSE_HEADING), F.regexp_extract("line", LOOSE_HEADING, 2))
    rows = rows.withColumn("heading", F.last(heading, True).over(w)).where(~F.col("is_fence") & ~F.col("in_fence") & F.col("line").rlike(CHECK))
    found = rows.select(key, "line_no", (F.lower(F.regexp_extract("line", CHECK, 1)) == "x").alias("done"), F.regexp_extract("line", CHECK, 2).alias("text"), criteria_kind(F.col("heading")).alias("criteria_kind"))
    order = Window.partitionBy(key, F.col("criteria_kind").isNull()).orderBy("line_no")
    return found.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))


def link_targets(body: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(filled(body), F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))))


def path_references(body: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(filled(body), F.lit(r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_-]+\.[A-Za-z0-9]+"), F.lit(0))))


def dates(body: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(filled(body), F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0))))


def front_matter(body: Column | str, name: str) -> Column:
    """A field of a leading --- block of 'name: value' lines; the empty string if there is none."""
    head = F.regexp_extract(filled(body), r"\A---\n((?:.*\n)*?)---(?:\n|\z)", 1)
    return F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)


def first_heading(body: Column | str) -> Column:
    return F.regexp_extract(filled(body), r"(?m)^# +(.+?)[ \t]*$", 1)


def title(body: Column | str, path: Column | str) -> Column:
    """Front matter, else the first top heading, else words of the file name with their first letters raised."""
    name = F.regexp_replace(F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]+$", ""), r"[-_]+", " ")
    human = F.array_join(F.transform(F.split(name, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), " ")
    return F.coalesce(F.nullif(front_matter(body, "title"), F.lit("")), F.nullif(first_heading(body), F.lit("")), human)


def status(text: Column | str) -> Column:
    """A status word as one of five; unknown words give 'unknown'."""
    s = F.lower(filled(text))
    return (
        F.when(s.rlike("supersed|deprecat|replaced"), "superseded").when(s.rlike("reject|abandon"), "rejected").when(s.rlike("accept|approv|done|implemented"), "accepted").when(s.rlike("draft|proposed|wip"), "draft").otherwise("unknown")
    )


def ticket_references(text: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(filled(text), F.lit(r"\b[A-Z][A-Z0-9]{1,9}-[0-9]{1,6}\b"), F.lit(0))))


def marker_units(rows: DataFrame, key: str, pattern: str, most: int = 80) -> DataFrame:
    """Units that begin at lines matching a pattern and end before the next one, at most so many lines: key, name, start, end."""
    w = Window.partitionBy(key).orderBy("line_no")
    last = Window.partitionBy(key)
    marked = rows.withColumn("_last", F.max("line_no").over(last)).where(F.col("line").rlike(pattern))
    nxt = F.coalesce(F.lead("line_no").over(w) - 1, F.col("_last"))
    return marked.select(key, F.regexp_extract("line", pattern, 1).alias("name"), F.col("line_no").alias("start_line"), F.least(nxt, F.col("line_no") + most - 1).alias("end_line"))
