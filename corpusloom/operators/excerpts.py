"""Excerpts of texts: matching lines with a line around them, gaps marked, up to a size. One row at a time, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import filled

# Size of an excerpt, in characters, the mark of a gap, and how checklist items begin.
MOST, GAP = 2200, "..."
CHECKLIST = r"^\s*[-*] \[[ x]\]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def excerpt(text: Column | str, terms: Column, most: int = MOST) -> Column:
    """Texts up to ``most`` characters are whole. Of others the lines that hold a term (lower-cased, an array) or are
    checklist items, and their neighbours, in order, with a gap mark where lines are left out, until ``most`` is reached; the
    beginning if no line matches. What is cut ends in a gap mark."""
    body, wanted = stripped(filled(text)), F.filter(terms, lambda t: t != "")
    hit = lambda x: F.exists(wanted, lambda t: F.contains(F.lower(x), t)) | F.lower(x).rlike(CHECKLIST)

    def chosen(lines: Column) -> Column:
        """Joined lines of an array of lines."""
        marks = F.array(F.transform(lines, hit))
        at = F.transform(marks, lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(m, i) | F.coalesce(F.get(m, i - 1), F.lit(False)) | F.coalesce(F.get(m, i + 1), F.lit(False))))[0]
        start = F.struct(F.lit("").alias("out"), F.lit(-2).alias("last"))

        def add(acc: Column, i: Column) -> Column:
            gap = F.when((acc["last"] >= 0) & (i > acc["last"] + 1), f"{GAP}\n").otherwise("")
            return F.when(F.length(acc["out"]) >= most, acc).otherwise(F.struct(F.concat(acc["out"], gap, F.element_at(lines, i + 1), F.lit("\n")).alias("out"), i.alias("last")))

        return F.aggregate(at, start, add, lambda acc: acc["out"])

    def cut(x: Column) -> Column:
        return F.concat(stripped(F.left(x, F.lit(most))), F.lit(f"\n{GAP}"))

    # arrays of one element, so that what stands in them is made once
    out = F.transform(F.transform(F.array(F.split(body, "\n")), chosen), stripped)
    return F.when(F.length(body) <= most, body).otherwise(F.transform(out, lambda x: F.when(x == "", cut(body)).when(F.length(x) > most, cut(x)).otherwise(x))[0])
