"""Evidence graph: concept statistics, pairs of documents that share rare concepts, merged edges, neighbours, greedy caps.

Pairs come only from concepts whose document frequency is small (a bound of the method), so a concept shared by a third of
all documents is dropped as noise before any pair is built, by the same rule at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .greedy import greedy_first, slot

MOST_SHARED = 6
NOISY_SHARE, NOISY_FROM = 0.35, 10
#: Forms with a digit or an inner capital are identifiers (strong concepts); other words are phrases of one word (weak ones).
IDENTIFIER = "[0-9]|[a-z][A-Z]"


def concept_stats(mentions: DataFrame, n: Column | int) -> DataFrame:
    """concept, df, idf and up to six forms, from mentions (doc, concept, form)."""
    n = F.lit(n) if isinstance(n, int) else n
    return mentions.groupBy("concept").agg(
        F.max(F.col("form").rlike(IDENTIFIER)).alias("identifier"),
        F.count_distinct("doc").alias("df"), F.round(F.log((1 + n) / (1 + F.count_distinct("doc"))) + 1, 6).alias("idf"), F.slice(F.array_sort(F.collect_set("form")), 1, 6).alias("forms")
    )


def noise_reason(df: Column, concept: Column, n: int, stop: tuple[str, ...] = ()) -> Column:
    return (
        F.when(df < 2, "single_artifact").when(df > MOST_SHARED, "too_many_artifacts").when(concept.isin(*stop) if stop else F.lit(False), "stop_word")
        .when((df / n > NOISY_SHARE) & F.lit(n >= NOISY_FROM), "high_document_frequency").otherwise("")
    )


def shared_pairs(mentions: DataFrame, stats: DataFrame, keep: int = 5) -> DataFrame:
    """src < dst with the number of shared rare concepts and, of the best ``keep`` (strong ones first): how many are strong and
    how many semantic (phrases), the sum and maximum of idf, and those concepts."""
    rare = stats.where((F.col("df") >= 2) & (F.col("df") <= MOST_SHARED)).select("concept", "idf", "identifier")
    rows = mentions.select("doc", "concept").distinct().join(rare, "concept")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, F.col("a.concept") == F.col("b.concept")).where("a.doc < b.doc").select(F.col("a.doc").alias("src"), F.col("b.doc").alias("dst"), F.col("a.concept").alias("concept"), F.col("a.idf").alias("idf"), F.col("a.identifier").alias("strong"))
    best = Window.partitionBy("src", "dst").orderBy(F.desc("strong"), F.desc("idf"), "concept")
    top = pairs.withColumn("r", F.row_number().over(best))
    return top.groupBy("src", "dst").agg(
        F.count("*").alias("shared"),
        F.count_if((F.col("r") <= keep) & F.col("strong")).alias("strong"),
        F.count_if((F.col("r") <= keep) & ~F.col("strong")).alias("semantic"),
        F.round(F.sum(F.when(F.col("r") <= keep, F.col("idf"))), 6).alias("idf_sum"),
        F.max(F.when(F.col("r") <= keep, F.col("idf"))).alias("idf_max"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= keep, F.struct("r", "concept")))), lambda s: s["concept"]), ",").alias("concepts"),
    )


def edge_scores(pairs: DataFrame) -> DataFrame:
    """Adds weight and confidence from strong, weak and the rarest of a pair's best concepts, both at most 1; confidence is at
    most 0.84 where none is strong or none is semantic."""
    strong, top = F.col("strong"), F.col("idf_max")
    weak = F.col("semantic")  # identifiers are strong and not semantic, phrases of one word are semantic and weak
    most = F.when((strong > 0) & (weak > 0), F.lit(1.0)).otherwise(F.lit(0.84))
    weight = F.least(0.32 + 0.12 * strong + 0.06 * weak + 0.04 * top, F.lit(1.0))
    return pairs.withColumn("weight", F.round(weight, 3)).withColumn("confidence", F.round(F.least(0.56 + 0.10 * strong + 0.04 * weak + 0.03 * top, most), 3))


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type): evidence summed, best weight and confidence, explanation of the first."""
    return edges.groupBy("src", "dst", "type").agg(
        F.sum("evidence").cast("long").alias("evidence"), F.max("weight").alias("weight"), F.max("confidence").alias("confidence"), F.min_by("explanation", "seq").alias("explanation")
    )


def neighbours(edges: DataFrame, seeds: DataFrame, per_type: int, least: float) -> DataFrame:
    """One hop from seeds (node, seed_rank) over edges in either direction: best ``per_type`` a seed and type, first seed wins."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type", "weight", "confidence").unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "type", "weight", "confidence")
    )
    order = Window.partitionBy("node", "type").orderBy(F.desc("weight"), F.desc("confidence"), "other")
    hop = both.where(F.col("confidence") >= least).join(seeds, "node").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_type)
    hop = hop.join(seeds.select(F.col("node").alias("other")), "other", "left_anti")
    return hop.groupBy("other").agg(F.min(F.struct("seed_rank", "r", "type", "node", "weight")).alias("b")).select(F.col("other").alias("node"), F.col("b.node").alias("seed"), "b.type", "b.weight")


def degree_capped(edges: DataFrame, group: str, most: int, per_node: int) -> DataFrame:
    """Greedy choice of edges (group, src, dst, score) in order of score: at most ``most`` a group and ``per_node`` a node.

    The cap of the group only ends the loop, so the degrees are filled in rounds among the first edges of each group, as far
    as the cap needs them; Spark cuts each task's part of a group to that number before it shuffles.
    """
    order = [F.desc("score"), F.col("src"), F.col("dst")]
    return greedy_first(edges.select(group, "src", "dst", "score"), order, [slot("node", per_node, group, "src"), slot("node", per_node, group, "dst")], most, group)
