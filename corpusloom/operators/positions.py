"""Positional postings: all clauses of a query, with phrases and prefixes.

A clause is a word or a quoted phrase; a star after it makes its last word a prefix. A phrase stands where its words follow
each other in one field. A query meets the documents that hold its rarest whole word, of which the number of documents is
counted first; the clauses are then counted inside the row of the document, so common words make no postings and no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, tokens

CLAUSE = r'"[^"]*"\*?|\S+'


def clauses(queries: DataFrame) -> DataFrame:
    """query_id, clause, n (words), prefix, idx, term for queries (query_id, text); clauses without words are left out."""
    raw = queries.select("query_id", F.posexplode(F.regexp_extract_all(filled("text"), F.lit(CLAUSE), F.lit(0))).alias("clause", "raw"))
    raw = raw.select("query_id", "clause", F.col("raw").endswith("*").alias("prefix"), tokens("raw").alias("words"))
    return raw.select("query_id", "clause", F.size("words").alias("n"), "prefix", F.posexplode("words").alias("idx", "term"))


def query_clauses(words: DataFrame) -> DataFrame:
    """query_id, clauses (array of n, prefix, init: its words but the last, last, said: how a text of words between blanks
    shows it) and must (words that a document must hold)."""
    each = words.groupBy("query_id", "clause", "n", "prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "term"))), lambda x: x["term"]).alias("terms"))
    said = F.concat(F.lit(" "), F.array_join("terms", " "), F.when(F.col("prefix"), "").otherwise(" "))
    init, last = F.slice("terms", 1, F.col("n") - 1), F.element_at("terms", -1)
    each = each.select("query_id", F.struct("n", "prefix", init.alias("init"), last.alias("last"), said.alias("said")).alias("c"), F.when(F.col("prefix"), init).otherwise(F.col("terms")).alias("must"))
    return each.groupBy("query_id").agg(F.collect_list("c").alias("clauses"), F.array_distinct(F.flatten(F.collect_list("must"))).alias("must"))


def places(texts: Column, c: Column) -> Column:
    """How many places of texts (arrays of words) a clause starts at."""

    def starts(t: Column, i: Column) -> Column:
        end = F.get(t, i + c["n"] - 1)
        return F.when(c["prefix"], F.startswith(end, c["last"])).otherwise(end == c["last"]) & ((c["n"] == 1) | (F.slice(t, i + 1, c["n"] - 1) == c["init"]))

    return F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.size(F.filter(t, lambda _, i: starts(t, i))))


def matches(docs: DataFrame, key: str, fields: dict[str, Column], queries: DataFrame) -> DataFrame:
    """query_id, key (each once in docs), hits (places of clauses) of the documents in which every clause of a query stands in
    some field. queries (query_id, text) are a stated set: they, and how many documents hold each of their words, go to all
    documents; nothing of a document is shuffled."""
    words = clauses(queries)
    asked = query_clauses(words)
    texts = docs.select(key, F.array(*[tokens(c) for c in fields.values()]).alias("_texts"))
    said = F.concat(F.lit(" "), F.array_join(F.transform("_texts", lambda t: F.array_join(t, " ")), " | "), F.lit(" "))  # no word has a bar
    texts = texts.withColumn("_said", said).withColumn("_words", F.array_distinct(F.flatten("_texts")))
    each = texts.select(key, "_texts", "_said", F.explode("_words").alias("term"))
    wanted = asked.select("query_id", F.explode("must").alias("term"))
    df = each.select("term").join(F.broadcast(wanted.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"))
    lead = wanted.join(df, "term").groupBy("query_id").agg(F.count("*").alias("held"), F.min_by("term", F.struct("df", "term")).alias("term"))
    by_word = asked.join(lead, "query_id").where(F.col("held") == F.size("must"))  # else a word is nowhere
    found = each.join(F.broadcast(by_word.drop("held")), "term").select("query_id", key, "_texts", "_said", "clauses")
    # queries of prefixes alone are met by the beginnings of words
    no_word = asked.where(F.size("must") == 0).withColumn("start", F.col("clauses")[0]["last"])
    lengths = no_word.agg(F.collect_set(F.length("start")).alias("_lengths")).where(F.size("_lengths") > 0)  # one row, or none
    beginnings = F.array_distinct(F.flatten(F.transform("_words", lambda t: F.transform(F.filter("_lengths", lambda n: n <= F.length(t)), lambda n: F.left(t, n)))))
    begun = texts.join(F.broadcast(lengths), F.lit(True)).select(key, "_texts", "_said", F.explode(beginnings).alias("start"))
    found = found.unionByName(begun.join(F.broadcast(no_word), "start").select("query_id", key, "_texts", "_said", "clauses"))
    # a search for bytes leaves only what matches; the places are counted in that
    whole = found.where(F.forall("clauses", lambda c: F.contains("_said", c["said"])))
    counts = F.transform("clauses", lambda c: places(F.col("_texts"), c))
    return whole.select("query_id", key, F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n).alias("hits"))


def holding(docs: DataFrame, key: str, fields: list[Column], queries: DataFrame) -> DataFrame:
    """query_id, key of the documents with a field that holds the whole text of a query, whatever the case. queries
    (query_id, text) are a stated set, sent to all documents as one row."""
    asked = queries.select("query_id", F.lower(filled("text")).alias("text")).where("text != ''")
    one = asked.agg(F.collect_list(F.struct("query_id", "text")).alias("_asked"))
    low = docs.select(key, F.array(*[F.lower(filled(c)) for c in fields]).alias("_in")).join(F.broadcast(one), F.lit(True))
    return low.select(key, F.explode(F.filter("_asked", lambda q: F.exists("_in", lambda f: F.contains(f, q["text"])))).alias("q")).select("q.query_id", key)
