"""Areas that overlap little: a greedy choice in which a taken area blocks all that share most of its members.

Overlaps come from an inverted index (areas that share a member), counted with a map-side combine. The greedy order is an
independent set of the conflict graph, found in rounds: an area without an open conflict before it is taken, and one with a
taken conflict goes. In random order the rounds grow with the logarithm of the areas, in a chain of conflicts with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .greedy import checkpointed

LEAST_OVERLAP = 0.72


def overlaps(members: DataFrame, order: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """before, after: areas of members (area, item, each once) that share at least ``least`` of the smaller one, in the order
    of order (area, place)."""
    placed = members.join(order.hint("merge"), "area")
    sizes = members.groupBy("area").agg(F.count("*").alias("n"))
    left, right = (placed.select("item", F.col("area").alias(n), F.col("place").alias(f"{n}_place")) for n in ("before", "after"))
    # both sides grow with the items, which the size of the files they come from does not tell: never sent whole
    shared = left.join(right.hint("merge"), "item").where("before_place < after_place").groupBy("before", "after").agg(F.count("*").alias("common"))
    both = shared.join(sizes.select(F.col("area").alias("before"), F.col("n").alias("n1")), "before").join(sizes.select(F.col("area").alias("after"), F.col("n").alias("n2")), "after")
    return both.where(F.col("common") / F.least("n1", "n2") >= least).select("before", "after")


def greedy_independent(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The nodes (area) that a loop takes which goes by the order of the conflicts (before, after) and takes a node unless a
    taken one before it conflicts with it."""
    conflicts = checkpointed(conflicts)
    opened, taken = checkpointed(nodes.select("area")), None
    while True:
        waiting = conflicts.select(F.col("after").alias("area")).distinct()
        now = checkpointed(opened.join(waiting, "area", "left_anti"))
        taken = now if taken is None else taken.union(now)
        gone = conflicts.join(now, conflicts["before"] == now["area"], "left_semi").select(F.col("after").alias("area")).distinct()
        opened = checkpointed(opened.join(now, "area", "left_anti").join(gone, "area", "left_anti"))
        if opened.isEmpty():
            return taken
        for side in ("before", "after"):
            conflicts = conflicts.join(opened, conflicts[side] == opened["area"], "left_semi")
        conflicts = checkpointed(conflicts)


def separate(areas: DataFrame, members: DataFrame, order: list[Column], most: int, least: float = LEAST_OVERLAP) -> DataFrame:
    """The first ``most`` areas of the greedy choice by order (ascending values, then name); areas without members conflict
    with none."""
    place = areas.select("area", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("area").alias("name")).alias("place"))
    kept = greedy_independent(areas, overlaps(members, place, least))
    return areas.join(kept, "area", "left_semi").orderBy(*order, "area").limit(most)
