"""Weighted range partitioning by sampled splitters, and exact prefix sums on top of it.

The splitters come from a sample whose expected size is fixed (``cells * PER_CELL`` keys), so what reaches the driver
does not grow with the data. Ranges that turn out too full are divided again by splitters drawn inside them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys for each range, on average.
PER_CELL = 24
#: A range is overfull beyond so many times its fair share.
OVERFULL = 1.5
ROUNDS = 4
LOWEST = -(2**63)
#: Rows of a range on average, and how many ranges there are at least and at most (the driver holds a few numbers of each).
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 100_000, 256, 20_000


def ranges_for(rows: int) -> int:
    """How many ranges to divide so many rows into: each is one task's work in ``with_offsets``."""
    return min(max(rows // ROWS_PER_RANGE, LEAST_RANGES), MOST_RANGES)


def _packed(cols: Sequence[np.ndarray]) -> np.ndarray:
    """Keys of several signed 64-bit columns as byte strings that compare in the same order."""
    out = np.empty((len(cols[0]), len(cols)), ">u8")
    for j, c in enumerate(cols):
        out[:, j] = np.asarray(c, np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view(f"S{8 * len(cols)}").ravel()


def _in_order(low: Sequence[Column], high: Sequence[Column], strict: bool) -> Column:
    """low < high (or <=), compared column by column."""
    out = F.lit(not strict)
    for x, y in reversed(list(zip(low, high, strict=True))):
        out = (x < y) | ((x == y) & out)
    return out


def with_cells(df: DataFrame, splitters: list[tuple[int, ...]], keys: Sequence[str]) -> DataFrame:
    """Adds _cell, the range of each row: how many splitters are at or below its key.

    Ranges are looked up by a hash join on the high bits of the first key, so a row meets few of them; a range that
    reaches over several values of those bits has a row for each.
    """
    if not splitters:
        return df.withColumn("_cell", F.lit(0))
    first, last = splitters[0][0], splitters[-1][0]
    shift = next(n for n in range(64) if (last >> n) - (first >> n) <= 2 * len(splitters))
    lowest, highest = first >> shift, last >> shift
    bounds = [None, *splitters, None]
    part = lambda s, end: end if s is None else s[0] >> shift
    rows = [(v, i, low, high) for i, (low, high) in enumerate(pairwise(bounds)) for v in range(part(low, lowest), part(high, highest) + 1)]
    table = {"_part": pa.array([r[0] for r in rows], pa.int64()), "_cell": pa.array([r[1] for r in rows], pa.int32())}
    for k, name in ((2, "_lo"), (3, "_hi")):
        table |= {f"{name}{j}": pa.array([r[k] and r[k][j] for r in rows], pa.int64()) for j in range(len(keys))}
    ranges = F.broadcast(df.sparkSession.createDataFrame(pa.table(table)))  # at most MOST_RANGES and three times as many rows
    key, low, high = ([F.col(x) for x in some] for some in (keys, [f"_lo{j}" for j in range(len(keys))], [f"_hi{j}" for j in range(len(keys))]))
    inside = (low[0].isNull() | _in_order(low, key, False)) & (high[0].isNull() | _in_order(key, high, True))
    at = F.least(F.greatest(F.shiftright(keys[0], shift), F.lit(lowest)), F.lit(highest))
    return df.join(ranges, (at == F.col("_part")) & inside).drop("_part", *[f"{n}{j}" for n in ("_lo", "_hi") for j in range(len(keys))])


def _drawn(df: DataFrame, keys: Sequence[str], weight: str, rate: float, seed: int) -> list[tuple]:
    """Size-weighted sample: a key is drawn floor(weight * rate + u) times, u from a hash of the key, so that lost tasks
    draw the same again."""
    u = (F.xxhash64(*keys, F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFF)) / F.lit(float(0x80000000))).cast("double")
    n = F.floor(F.col(weight) * F.lit(rate) + u).cast("int")
    return [tuple(r) for r in df.select(*keys, n.alias("_n")).where("_n > 0").collect()]


def _quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    rows = sorted(sample)
    if not rows or parts < 2:
        return []
    upto = np.cumsum([r[-1] for r in rows])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts, "left")
    return [rows[i][:-1] for i in dict.fromkeys(at.tolist())]


def sampled_splitters(df: DataFrame, keys: Sequence[str], weight: str, cells: int, *, whole: int | None = None, seed: int = 17) -> list[tuple[int, ...]]:
    """Splitters that divide df, ordered by its integer keys, into about ``cells`` ranges of equal weight.

    whole: so many leading keys that rows which agree in them stay in one range, unless that range is overfull; then its
    rows are divided by all keys. Empty tables get no splitters.
    """
    total = df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    if not total:
        return []
    share = total / cells
    cut = lambda s: s if whole is None else (*s[:whole], *[LOWEST] * (len(keys) - whole))
    splitters = sorted({cut(s) for s in _quantiles(_drawn(df, keys, weight, cells * PER_CELL / total, seed), cells)})
    for turn in range(1, ROUNDS):
        placed = with_cells(df.select(*keys, weight), splitters, keys)
        full = {r[0]: r[1] for r in placed.groupBy("_cell").agg(F.sum(weight).alias("w")).where(F.col("w") > OVERFULL * share).collect()}
        if not full:
            break
        sample = _drawn(placed.where(F.col("_cell").isin(list(full))), keys, weight, PER_CELL / share, seed + turn)
        at = np.searchsorted(_packed([np.array([s[j] for s in splitters], np.int64) for j in range(len(keys))]), _packed([np.array([s[j] for s in sample], np.int64) for j in range(len(keys))]), "right") if splitters and sample else np.zeros(len(sample), int)
        more = set(splitters)
        for c, w in full.items():
            more.update(_quantiles([s for s, k in zip(sample, at, strict=True) if k == c], int(np.ceil(w / share)) + 1))
        if len(more) == len(splitters):
            break
        splitters = sorted(more)
    return splitters


def with_offsets(df: DataFrame, keys: Sequence[str], weight: str, splitters: list[tuple[int, ...]]) -> DataFrame:
    """Adds _cell, _rank (rows before this one in key order) and _offset (weight before it), exactly, over the whole table.

    Each range is one window partition; between ranges only one row of totals a range is added up.
    """
    placed = with_cells(df, splitters, keys)
    totals = {r[0]: (r[1], r[2]) for r in placed.groupBy("_cell").agg(F.count(F.lit(1)), F.sum(weight)).collect()}
    spark, rows, n, w = df.sparkSession, [], 0, 0
    for c in range(len(splitters) + 1):
        rows.append((c, n, w))
        n, w = n + totals.get(c, (0, 0))[0], w + totals.get(c, (0, 0))[1]
    # one row a range, and there are at most a few times as many ranges as were asked for
    before = F.broadcast(spark.createDataFrame(pa.table({n: pa.array(c, t) for n, c, t in zip(("_cell", "_n0", "_w0"), zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)})))
    order = Window.partitionBy("_cell").orderBy(*keys)
    return (
        placed.withColumn("_i", F.row_number().over(order) - 1)
        .withColumn("_w", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
        .join(before, "_cell")
        .withColumn("_rank", F.col("_i") + F.col("_n0"))
        .withColumn("_offset", F.col("_w") + F.col("_w0"))
        .drop("_i", "_w", "_n0", "_w0")
    )
