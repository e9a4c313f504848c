"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Base spans (assign, access, hex) come from regular expressions; positions come from the lengths of the pieces between the
matches, in code points. Candidates for further spans are key-like tokens: runs of 20 and more characters of the base64
alphabet with a lower-case letter, an upper-case letter and a digit, outside the base spans, and values of base spans.
The hash of each candidate value is aggregated over the corpus by distinct repositories and owners. A value that many
owners hold is a copied example; one that few owners hold is owner-specific and looks live. Key-like tokens that are
owner-specific become spans of kind 'owned'; base spans always stay and are told apart as examples or live. A value in
more than MOST_REPOSITORIES repositories for each of its owners is a copied example too, however few the owners are.

An owner is a source, a repository is a document of it (parameters). Hot values: the aggregate has a map-side combine over
(value, owner), and the join back to the occurrences splits skewed partitions (no window or group needs all its rows).

Nulls, ties and odd input: a null text counts as empty (zero counts, sha256 of the empty string, empty spans); a null
source is an owner of its own; repeated rows of one doc_id are scanned one by one and each gets a row with its own spans,
the doubled rows counting as one repository; an empty table gives no rows; other columns are ignored. Spans over a whole
text are found however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_if_null, stored, table

#: Kinds in the order that breaks ties, with their patterns. A match of assign counts if its value has LEAST characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST = 6
KINDS = ("assign", "access", "hex", "owned")
#: Key-like tokens: long enough, with letters of both cases and digits. Tokens are cut at other characters.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: A value held by at most so many owners is owner-specific; by more, it is a copied example.
MOST_OWNERS = 2
#: So is one that is in more repositories than this for each owner.
MOST_REPOSITORIES = 100
#: Matches whose positions are added up together.
RUN = 128


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Array of struct(start, kind, end, value) for the leftmost non-overlapping matches: the text is split at the matches,
    so the lengths of the gaps and matches before one add up to its start. They are added up inside runs of RUN matches
    and over the runs, since a running sum over all of them would copy what it has for each match."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = "array<struct<start:int,kind:int,end:int,value:string>>"

    def span(start: Column, value: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"))

    def run(parts: Column) -> Column:
        """struct(at: length of the run, out: its spans, from the run's start)."""
        return F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
                F.concat(acc["out"], F.array(span(acc["at"] + F.length(x["gap"]), x["hit"]))).cast(spans).alias("out"),
            ),
        )

    def upto(runs: Column) -> Column:
        """The length of the text before each run."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(runs, start, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def moved(runs: Column) -> Column:
        return F.flatten(F.zip_with(runs, upto(runs), lambda r, at: F.transform(r["out"], lambda x: span(x["start"] + at, x["value"]))))

    # arrays of one element, so that what stands in them is made once
    parts = F.array(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")))
    runs = F.transform(parts, lambda z: F.transform(F.sequence(F.lit(0), F.size(z) - 1, F.lit(RUN)), lambda lo: run(F.slice(z, lo + 1, F.lit(RUN)))))
    return F.when(text.rlike(pattern), F.transform(runs, moved)[0]).otherwise(F.array().cast(spans))


def _outside(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span, in order: starts of base spans and ends of tokens are swept in one sorted row,
    with the furthest end of a base span so far (first by runs of RUN, then inside a run)."""
    event = lambda at, what, other, x: F.struct(at.alias("at"), F.lit(what).alias("what"), other.alias("other"), x.alias("span"))
    row = F.array_sort(F.concat(F.transform(base, lambda b: event(b["start"], 1, b["end"], b)), F.transform(tokens, lambda x: event(x["end"], 0, x["start"], x))))
    furthest = lambda part: F.coalesce(F.array_max(F.transform(F.filter(part, lambda e: e["what"] == 1), lambda e: e["other"])), F.lit(0))

    def upto(runs: Column) -> Column:
        """The furthest end before each run."""
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(runs, start, lambda acc, r: F.struct(F.greatest(acc["end"], furthest(r)).alias("end"), F.concat(acc["out"], F.array(acc["end"])).alias("out")), lambda acc: acc["out"])

    def free(run: Column, before: Column) -> Column:
        open_ = lambda e, i: (e["what"] == 0) & (F.greatest(before, furthest(F.slice(run, 1, i))) <= e["other"])
        return F.transform(F.filter(run, open_), lambda e: e["span"])

    # arrays of one element, so that what stands in them is made once
    runs = F.transform(F.array(row), lambda z: F.transform(F.sequence(F.lit(0), F.size(z) - 1, F.lit(RUN)), lambda lo: F.slice(z, lo + 1, F.lit(RUN))))
    swept = F.transform(runs, lambda r: F.array_sort(F.flatten(F.zip_with(r, upto(r), free))))[0]
    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), swept).otherwise(tokens)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, *, owner: str = "source", repository: str = "doc_id", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all, comma-joined), n_owned, n_example (base spans whose value
    more than most_owners owners, or more than most_repositories repositories an owner, hold), n_live (the other base spans)."""
    text = blank_if_null()
    scanned = docs.select("doc_id", F.col(owner).cast("string").alias("_owner"), F.col(repository).cast("string").alias("_repo"), text.alias("_text"))
    scanned = scanned.select(
        "doc_id",
        "_owner",
        "_repo",
        F.filter(_found(F.col("_text"), ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= LEAST).alias("a"),
        _found(F.col("_text"), ACCESS, 1).alias("k"),
        _found(F.col("_text"), HEX, 2).alias("h"),
        F.filter(
            _found(F.col("_text"), TOKEN, 3), lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]")
        ).alias("t"),
    )
    base = F.array_sort(F.concat("a", "k", "h"))
    # found once, then kept: a row holds spans, not texts
    found = stored(
        scanned.withColumn("base", base).select(
            F.expr("uuid()").alias("_row"),
            "doc_id",
            "_owner",
            "_repo",
            *[F.size(c).cast("long").alias(n) for n, c in (("n_assign", "a"), ("n_access", "k"), ("n_hex", "h"))],
            "base",
            _outside(F.col("t"), F.col("base")).alias("more"),
        )
    )
    secret = F.when(F.col("c.kind") == 0, F.regexp_extract(F.col("c.value"), ASSIGN, 2)).otherwise(F.col("c.value"))
    each = found.where(F.size("base") + F.size("more") > 0).select("_row", "_owner", "_repo", F.explode(F.concat("base", "more")).alias("c"))
    each = stored(each.select("_row", "_owner", "_repo", F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), F.col("c.end").alias("end"), F.sha2(secret, 256).alias("value")))
    owners = stored(
        each.select("value", "_owner", "_repo").distinct().groupBy("value", "_owner").agg(F.count("*").alias("n"))
        .groupBy("value").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))
    )
    own = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories * F.col("owners"))
    judged = each.join(owners, "value").select("_row", "start", "kind", "end", own.alias("own"))
    per_doc = judged.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") < 3) | F.col("own"), F.struct("start", "kind", "end")))).alias("all"),
        F.count_if((F.col("kind") == 3) & F.col("own")).alias("n_owned"),
        F.count_if((F.col("kind") < 3) & ~F.col("own")).alias("n_example"),
        F.count_if((F.col("kind") < 3) & F.col("own")).alias("n_live"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.join(per_doc, "_row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), F.coalesce(_joined(F.col("all")), F.lit("")).alias("spans"), *map(zero, ("n_owned", "n_example", "n_live"))
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op3_secrets": op3_secrets}
ORACLE_SQL: dict[str, str] = {}
