"""Inverted-index search: postings, BM25, matching lanes and their ordered union.

Tokens are filtered to the terms of the query batch before they are grouped, so what is shuffled are hits, never the postings
of the corpus. The terms are a small side whose size the optimizer measures. BM25 sends its three sides that are no larger than
the query batch (terms, their frequencies, the batch) to every task, so that it keeps the way in which documents are dealt:
where that is by their key, nothing that grows with hits or with pairs of queries and documents is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, term, tf of each distinct term of each document."""
    return docs.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def hits(docs: DataFrame, key: str | list[str], text: Column, terms: DataFrame) -> DataFrame:
    """key, term, tf, len (of the document in tokens) of each wanted term (terms: term, each once) of each document."""
    keys = [key] if isinstance(key, str) else key
    # the outer kind drops no row, so no filter on the tokens is worked out beside the scan, before rows are dealt to tasks
    each = docs.select(*keys, tokens(text).alias("_t")).select(*keys, F.size("_t").cast("long").alias("len"), F.explode_outer("_t").alias("term"))
    return each.join(terms, "term").groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def idf(n: Column, df: Column) -> Column:
    """Robertson weight with a small positive floor."""
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def corpus(docs: DataFrame, text: Column) -> DataFrame:
    """n, avglen: one row about all documents."""
    return docs.select(F.size(tokens(text)).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avglen"))


def bm25(docs: DataFrame, key: str | list[str], text: Column, queries: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """query_id, key, score (best first is highest) for queries (query_id, term); over: the corpus, if docs are not all of it."""
    keys = [key] if isinstance(key, str) else key
    found = hits(docs, keys, text, F.broadcast(queries.select("term").distinct()))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    tf = F.col("tf")
    weight = idf(F.col("n"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avglen")))
    # corpus is a single row: a scalar, not a growing side
    scored = found.join(F.broadcast(df), "term").join(F.broadcast(corpus(docs, text) if over is None else over)).select(*keys, "term", weight.alias("weight"))
    return scored.join(F.broadcast(queries), "term").groupBy("query_id", *keys).agg(F.round(F.sum("weight"), 6).alias("score"))


def bm25_best(docs: DataFrame, key: str, text: Column, queries: DataFrame, most: int) -> DataFrame:
    """query_id, key, score, rank: the best so many of bm25 for each query, by score and key; keys stand in one row each.
    Documents of one length that hold the same wanted terms equally often have one score, so these groups are scored and give
    their first keys: a text is read once, and groups, not documents, meet queries."""
    # the outer kind drops no row, so no filter on the tokens is worked out beside the scan, before rows are dealt to tasks
    each = docs.select(key, F.explode_outer(tokens(text)).alias("_t"))
    wanted = queries.select(F.col("term").alias("_w")).distinct()
    held = each.join(wanted, F.col("_t") == F.col("_w"), "left").groupBy(key).agg(F.count("_t").alias("len"), F.array_sort(F.collect_list("_w")).alias("terms"))
    groups = held.groupBy("len", "terms").agg(F.count("*").alias("n"))
    corpus = groups.agg(F.sum("n").alias("docs"), (F.sum(F.col("n") * F.col("len")) / F.sum("n")).alias("avglen"))
    terms = groups.select("len", "terms", "n", F.explode(F.array_distinct("terms")).alias("term"))
    tf = F.size(F.filter("terms", lambda t: t == F.col("term")))
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    weight = idf(F.col("docs"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avglen")))
    # corpus is a single row: a scalar, not a growing side
    scored = terms.join(df, "term").join(F.broadcast(corpus)).select("len", "terms", "term", weight.alias("weight"))
    scored = scored.join(queries, "term").groupBy("query_id", "len", "terms").agg(F.round(F.sum("weight"), 6).alias("score"))
    # of a group, no more than its first keys are among the best of a query
    first = held.where(F.size("terms") > 0).withColumn("_n", F.row_number().over(Window.partitionBy("len", "terms").orderBy(key))).where(F.col("_n") <= most)
    return top_per(scored.join(first.drop("_n"), ["len", "terms"]).select("query_id", key, "score"), "query_id", [F.desc("score"), F.col(key)], most)


def all_terms(docs: DataFrame, text: Column, queries: DataFrame, key: str) -> DataFrame:
    """query_id, key of documents that hold every term of a query."""
    need = queries.groupBy("query_id").agg(F.count_distinct("term").alias("need"))
    return hits(docs, key, text, queries.select("term").distinct()).join(queries.distinct(), "term").groupBy("query_id", key).agg(F.count("*").alias("got")).join(need, "query_id").where("got = need").select("query_id", key)


def lanes_union(lanes: list[DataFrame], key: str, most: int) -> DataFrame:
    """Ordered union of lanes (each key, pos), first lane and position win, capped: key, lane, pos, rank."""
    merged = None
    for i, lane in enumerate(lanes):
        one = lane.select(key, F.lit(i).alias("lane"), F.col("pos").cast("long").alias("pos"))
        merged = one if merged is None else merged.unionByName(one)
    first = merged.groupBy(key).agg(F.min(F.struct("lane", "pos")).alias("f")).select(key, "f.lane", "f.pos")
    top = first.orderBy("lane", "pos", key).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("lane", "pos", key)).cast("long"))


def top_per(df: DataFrame, group: str, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col(rank) <= n)
