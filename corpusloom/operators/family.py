"""Primary rows of a pack by families: what a row is worth depends on what its family has in the pack already.

Rows of one folder and stem, sources and their tests, are a family. The choice goes by stages: protected rows, then the best
source and test of each of the strongest families, then rows of high score, then any until a floor. A row belongs to the
first stage that wants it, so the whole choice is one order of rows by (stage, family, place) and a cap; ranks are windows
over the rows of one pack, whose size the pack's limit bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled
from .candidates import _parts, identifier_words

# Rows that are primary without and with protection, families that are strong, protected rows, the least score
# of a row for its own sake and of a protected one, rows that a pack has at least.
MOST, MOST_PROTECTED_MODE, STRONG_FAMILIES, PROTECTED, LEAST_SCORE, SAFE_SCORE, FLOOR = 6, 8, 4, 4, 7.0, 10.0, 4
# Points of a query's term for its place, for an early rank and for a test; as it is, and by rarity in the pack.
POINTS, RANK_POINTS, RANK_STEP, TEST_POINTS = {"stem": 8.0, "token": 3.0, "path": 2.0, "title": 2.5, "reasons": 1.0}, 2.5, 0.12, 0.5
RARE_POINTS, RARE_RANK_POINTS, RARE_RANK_STEP, RARE_TEST_POINTS = {"stem": 8.0, "token": 4.5, "path": 3.5, "title": 3.0, "reasons": 1.25}, 2.8, 0.10, 0.75
# Endings of sources, words that are no terms, folders of tests, reasons that protect a row, weak folders.
SOURCES = ("c", "cc", "cpp", "cs", "css", "go", "java", "js", "jsx", "kt", "php", "py", "rs", "scss", "swift", "ts", "tsx", "vue")
STOP = ("a", "an", "and", "are", "as", "at", "be", "before", "by", "can", "change", "changes", "code", "correct", "correctly", "do", "does", "done", "file", "files", "fix", "for", "from", "get", "handle", "handling", "helper", "helpers", "if", "in", "index", "into", "is", "it", "make", "manager", "new", "node", "of", "old", "on", "or", "set", "sets", "should", "support", "the", "to", "update", "use", "uses", "using", "util", "utils", "when", "with", "without", "work")
TEST_FOLDERS = ("test", "tests", "spec", "specs", "e2e")
SAFE_REASONS = "source-family ranking|scout_anchor_admission|source_manifest_family_recovery|source_manifest_consumption_recovery|source_manifest_loss_safe_preserved|same_stem_source_recovery"
WEAK = r"/docs_src/|^docs_src/|/tutorial|/examples/|^examples/|/(fixtures|testdata|vendor|node_modules|generated|dist)/"
TESTS = r"/(test|tests|__tests__)/|_test\.(go|py)$|(^|/)test_[^/]*$|\.(test|spec)\.[^/]*$"


def compact(c: Column) -> Column:
    """Letters and digits, lower-cased."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", "")


def bare_path(c: Column) -> Column:
    """A path without a line reference."""
    return F.regexp_extract(c, "^([^#]*)", 1)


def stem(path: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(bare_path(path), "/"), -1), r"\.[^.]*$", "")
    return compact(F.regexp_replace(F.regexp_replace(name, r"(?:[.](?:test|spec)|[_-]test)+$", ""), "^test_", ""))


def row_class(path: Column, subtype: Column) -> Column:
    p = F.lower(bare_path(path))
    return F.when(p.rlike(TESTS) | (subtype == "test_case"), "test").when(F.regexp_extract(p, r"\.([^./]*)$", 1).isin(*SOURCES), "source").otherwise("other")


def query_terms(text: Column) -> Column:
    """Compact terms of a query: its words, with their parts, of three letters and more, each once."""
    words = identifier_words(filled(text))
    every = F.flatten(F.transform(words, lambda t: F.concat(F.array(compact(t)), F.transform(_parts(t), compact))))
    return F.array_distinct(F.filter(every, lambda t: (F.octet_length(t) >= 3) & ~t.isin(*STOP)))


def pack_rows(pack: DataFrame, queries: DataFrame, by_rarity: bool = False) -> DataFrame:
    """pack (query_id, key, path, title, subtype, rank, reasons) with class, family and score for the terms of its query
    (queries: query_id, text)."""
    path, low = F.col("path"), F.lower("path")
    points = RARE_POINTS if by_rarity else POINTS
    folders = F.filter(F.slice(F.split(bare_path(path), "/"), 1, F.greatest(F.size(F.split(bare_path(path), "/")) - 1, F.lit(0))), lambda d: ~compact(d).isin(*TEST_FOLDERS) & (d != ""))
    parent = F.lower(F.array_join(F.slice(folders, F.greatest(F.size(folders) - 2, F.lit(1)), F.lit(3)), "/"))
    df = pack.join(queries.select("query_id", query_terms(F.col("text")).alias("terms")), "query_id")
    df = df.withColumn("class", row_class(path, F.lower(filled("subtype")))).withColumn("stem", stem(path)).withColumn("parent", parent)
    df = df.withColumn("_path", compact(low)).withColumn("_title", compact(filled("title"))).withColumn("_reasons", compact(filled("reasons")))
    segments = F.split(low, "/")
    df = df.withColumn("_tokens", F.concat(F.flatten(F.transform(segments, lambda s: F.split(s, r"[^\p{L}\p{Nd}]+"))), F.transform(segments, compact)))

    def worth(t: Column) -> Column:
        return (
            F.when(t == F.col("stem"), points["stem"]).when(F.array_contains("_tokens", t), points["token"]).when(F.contains("_path", t), points["path"])
            .when(F.contains("_title", t), points["title"]).when(F.contains("_reasons", t), points["reasons"]).otherwise(0.0)
        )

    rank = F.when(F.col("rank") > 0, F.col("rank")).otherwise(99)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    if by_rarity:
        df = df.withColumn("_worth", F.transform("terms", lambda t: F.struct(t.alias("term"), worth(t).alias("w"))))
        pack_ = Window.partitionBy("query_id")
        held = F.flatten(F.collect_list(F.transform(F.filter("_worth", lambda x: x["w"] > 0), lambda x: x["term"])).over(pack_))
        df = df.withColumn("_n", F.count("*").over(pack_)).withColumn("_held", held)

        def weight(t: Column) -> Column:
            """How rare a term is among the rows of its pack."""
            n = F.size(F.filter("_held", lambda x: x == t))
            share = n / F.col("_n")
            return F.when(n <= 1, 2.4).when(n <= 2, 2.0).when(n <= 4, 1.6).when(share <= 0.35, 1.25).when(share >= 0.7, 0.45).otherwise(0.8)

        score = total(F.transform("_worth", lambda x: F.when(x["w"] > 0, x["w"] * weight(x["term"])).otherwise(0.0)))
        score += F.greatest(RARE_RANK_POINTS - rank * RARE_RANK_STEP, F.lit(0.0)) + F.when(F.col("class") == "test", RARE_TEST_POINTS).otherwise(0.0)
    else:
        score = total(F.transform("terms", worth)) + F.greatest(RANK_POINTS - rank * RANK_STEP, F.lit(0.0)) + F.when(F.col("class") == "test", TEST_POINTS).otherwise(0.0)
    own = F.when(F.array_contains("terms", F.col("stem")), F.concat(F.lit("stem:"), "stem"))
    alone = F.when(F.col("parent") == "", F.concat_ws(":", "class", F.when(F.col("stem") != "", F.col("stem")).otherwise("unknown")))
    family = F.coalesce(own, alone, F.concat_ws("/", "parent", F.when(F.col("stem") != "", F.col("stem"))))
    return df.select(*pack.columns, "class", family.alias("family"), F.round(score, 6).alias("score"))


def primary(rows: DataFrame, key: str, protect: bool = True) -> DataFrame:
    """rows (query_id, key, path, rank, reasons, class, family, score) with primary; protect: early, high and recovered
    sources and tests go first, and more rows are primary."""
    most = MOST_PROTECTED_MODE if protect else MOST
    pack = Window.partitionBy("query_id")
    best = [F.desc("score"), F.col("rank"), F.col("path"), F.col(key)]
    place = lambda *by: F.row_number().over(Window.partitionBy("query_id", *by).orderBy(*best))
    df = rows.withColumn("_best", F.max("score").over(Window.partitionBy("query_id", "family")))
    df = df.withColumn("_family", F.dense_rank().over(pack.orderBy(F.desc("_best"), "family"))).withColumn("_in_family", place("family")).withColumn("_in_class", place("family", "class"))
    reasons = F.lower(filled("reasons"))
    safe = F.col("class").isin("source", "test") & ~F.lower(bare_path(F.col("path"))).rlike(WEAK) & (F.col("rank").between(1, 2) | (F.col("score") >= SAFE_SCORE) | reasons.rlike(SAFE_REASONS))
    first = pack.orderBy(F.desc("_safe"), F.desc(reasons.contains("scout_anchor_admission")), F.col("rank"), F.desc("score"), F.col("path"), F.col(key))
    df = df.withColumn("_safe", safe).withColumn("_safe_place", F.row_number().over(first))
    at = lambda stage, a, b: F.struct(F.lit(stage).alias("stage"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    zero = F.lit(0)
    stages = [
        F.when(F.lit(protect) & F.col("_safe") & (F.col("_safe_place") <= PROTECTED), at(0, F.col("_safe_place"), zero)),
        F.when((F.col("_family") <= STRONG_FAMILIES) & (F.col("_in_class") == 1) & F.col("class").isin("source", "test"), at(1, F.col("_family"), F.col("class") == "test")),
        F.when(F.col("score") >= LEAST_SCORE, at(2, F.col("_family"), F.col("_in_family"))),
        at(3, F.col("_family"), F.col("_in_family")),
    ]
    df = df.withColumn("_at", F.coalesce(*stages)).withColumn("_n", F.row_number().over(pack.orderBy("_at")))
    return df.select(*rows.columns, (F.col("_n") <= F.when(F.col("_at.stage") < 3, most).otherwise(min(most, FLOOR))).alias("primary"))
