"""Embedding near-dedup by sorted projection passes.

Equal vectors of a label are merged first. Each pass gives every vector a key of concatenated random hashes (a hash is the
random direction of largest absolute projection, with its sign; nearer vectors agree in more of the leading hashes), sorts
by (label, size, key) and compares each vector with the WINDOW next ones at least. Pairs whose cosine in double precision
reaches ``least`` are links. A window returns as few links as join the same vectors, never its pairs; the links of all
passes are united into components (large-star and small-star steps on tables).

What the windows are too narrow for is completed exactly within the components: every two members meet, so n_links counts
all links of a component, though it is larger than any window. Components up to CELL members are one group. Larger ones
are cut into cells; members within half the angle of ``least`` of the component's mean are all linked to one another by
the triangle inequality, so they are counted without meeting, and only the others meet all members. Cells return one
number for each member.

Recall: two vectors of different components that would link are found unless all passes sort them more than a window
apart. The number of passes follows from the largest label, so that a pair at exactly ``least`` is missed with a
probability of MISS at most (``passes_for``), nearer pairs with less; labels up to WINDOW vectors are compared whole.

Skew: a vector that a third of all rows share is one row after a merge with a map-side combine; the join back to the rows
is plain, and the engine splits its skewed partitions. Passes are dealt out by ranges of the sort key, and rows stream
through a task by windows; windows across the ends of partitions are compared in a second step from the rows at the ends.

Nulls, ties and odd input: vectors that are null, empty or zero, or hold nulls or non-finite components, and vectors
without label link with nothing; vectors of different sizes do not link; rows that repeat a vec_id are vectors of their
own (equal ones are linked), and their component is named by the least vec_id; a null vec_id counts as the largest, and
its row is kept if no member has an id and never otherwise; an empty table gives no rows; only vec_id, embedding and label
are read, so other columns cannot clash. Vectors are merged by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, cos, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .nearest import components

SIMILAR = 0.93
#: Vectors that each one is compared with at least, in both directions, in a pass.
WINDOW = 512
#: Random directions of a hash; a hash has twice as many values.
DIRECTIONS = 64
MISS = 0.01
SEED = 13
#: Members of a block of a component.
CELL = 4096
#: Bytes of vectors in a partition of a pass.
PART = 32_000_000
LAST = 2**63 - 1


# --- numpy inside tasks ---------------------------------------------------------------------------------------------


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a and b (of length 1) have a cosine of at least ``least``: in single precision, and again in double
    precision where that leaves a doubt."""
    near = a.astype(np.float32) @ b.astype(np.float32).T
    doubt = max(1e-5, a.shape[1] * 4e-7)
    yes = near >= least + doubt
    i, j = np.nonzero((near >= least - doubt) & ~yes)
    for lo in range(0, len(i), 100_000):
        s = slice(lo, lo + 100_000)
        yes[i[s], j[s]] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) >= least
    return yes


def joining(yes: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """As few of the links (row, column) as join the same vectors; same: rows and columns are the same vectors."""
    n, m = yes.shape
    own, out = np.arange(m if same else m + n), []  # class of each column, then of each row
    for i in np.flatnonzero(yes.any(1)).tolist():
        me = i if same else m + i
        hits = np.flatnonzero(yes[i])
        classes, at = np.unique(own[hits], return_index=True)
        other = classes != own[me]
        out += [(i, j) for j in hits[at[other]].tolist()]
        own[np.isin(own, classes[other])] = own[me]
    return out


def hash_keys(x: np.ndarray, turn: int, hashes: int, directions: int = DIRECTIONS) -> np.ndarray:
    """Concatenated hashes of unit rows, as numbers that sort as the hashes do."""
    key = np.zeros(len(x), np.int64)
    x = x.astype(np.float32)
    for h in range(hashes):
        r = np.random.default_rng([SEED, turn, h, x.shape[1]]).standard_normal((x.shape[1], directions), np.float32)
        y = x @ r
        best = np.abs(y).argmax(1)
        key = key * (2 * directions) + 2 * best + (y[np.arange(len(y)), best] > 0)
    return key


def passes_for(largest: int, least: float, window: int = WINDOW, miss: float = MISS, directions: int = DIRECTIONS) -> tuple[int, int]:
    """How many passes, and how many hashes a key, so that a pair of cosine ``least`` among ``largest`` vectors is missed
    with a probability of ``miss`` at most. Two vectors lie within a window if they agree in so many leading hashes that
    fewer than a window's vectors do; whether they agree in one is drawn from correlated normal numbers."""
    if largest <= window:
        return 1, 1
    rng = np.random.default_rng(SEED)
    a = rng.standard_normal((4000, directions))
    b = least * a + (1 - least**2) ** 0.5 * rng.standard_normal(a.shape)
    i, j = np.abs(a).argmax(1), np.abs(b).argmax(1)
    p = float(((i == j) & (a[np.arange(4000), i] * b[np.arange(4000), j] > 0)).mean())
    depth = ceil(log(largest / window) / log(2 * directions))
    most = 62 // (2 * directions - 1).bit_length()
    return ceil(log(miss) / log(1 - p**depth)), min(depth + 2, most)


def _vectors(col: pa.Array | pa.ChunkedArray, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(v, kind) for v in col.to_pylist()]


class _Window:
    """Compares vectors that come in sorted order with the WINDOW ones before them, at least."""

    def __init__(self, least: float, window: int):
        self.least, self.window = least, window
        self.key, self.group, self.x = np.empty(0, np.int64), np.empty(0, np.int64), None

    def links(self, key: np.ndarray, group: np.ndarray, x: np.ndarray) -> list[tuple[int, int]]:
        """Links among up to WINDOW new vectors of one size, and between them and those before."""
        out = []
        if self.x is None or self.x.shape[1] != x.shape[1]:
            self.key, self.group, self.x = key[:0], group[:0], x[:0]
        for g in np.unique(group).tolist():
            new, old = np.flatnonzero(group == g), np.flatnonzero(self.group == g)
            yes = linked(x[new], x[new], self.least)
            np.fill_diagonal(yes, False)
            out += [(int(key[new[i]]), int(key[new[j]])) for i, j in joining(yes, same=True)]
            if len(old):
                out += [(int(key[new[i]]), int(self.key[old[j]])) for i, j in joining(linked(x[new], self.x[old], self.least), same=False)]
        keep = max(self.window - len(key), 0)
        cut = max(len(self.key) - keep, 0)
        self.key, self.group, self.x = np.concatenate([self.key[cut:], key]), np.concatenate([self.group[cut:], group]), np.concatenate([self.x[cut:], x])
        return out


_ROW = "a long, b long, part int, at long, grp long, size int, key long, vec binary"
_NAMES = ["a", "b", "part", "at", "grp", "size", "key", "vec"]


def _rows(**cols: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols.get(c, [None] * n), k) for c, k in zip(_NAMES, kinds, strict=True)], _NAMES)


# --- jobs -----------------------------------------------------------------------------------------------------------


def _one_pass(vectors: DataFrame, turn: int, parts: int, least: float, window: int, kind: np.dtype) -> DataFrame:
    """Links (a, b) of one pass over vectors (key, grp, size, vec, keys)."""
    dealt = vectors.select("grp", "size", F.col("keys")[turn].alias("hash"), "key", "vec").repartitionByRange(parts, "grp", "size", "hash", "key")
    dealt = dealt.sortWithinPartitions("grp", "size", "hash", "key").select("grp", "size", "key", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, part, at = _Window(least, window), TaskContext.get().partitionId(), 0
        tail: list[pa.RecordBatch] = []
        for whole in batches:
            for b in (whole.slice(lo, window) for lo in range(0, len(whole), window)):
                size = b.column("size").to_numpy()
                cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(b)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    s = b.slice(lo, hi - lo)
                    links = w.links(s.column("key").to_numpy(), s.column("grp").to_numpy(), unit(np.stack(_vectors(s.column("vec"), kind))))
                    if links:
                        yield _rows(a=[x for x, _ in links], b=[y for _, y in links])
                if at < window:  # the first rows, for the windows of the partitions before
                    yield _ends(b.slice(0, window - at), part, at)
                tail.append(b)
                at += len(b)
                while len(tail) > 1 and sum(map(len, tail[1:])) >= window:
                    tail.pop(0)
        if at:
            last = pa.Table.from_batches(tail).combine_chunks().to_batches()[0]
            yield _ends(last.slice(max(len(last) - window, 0)), part, -1)
            yield _rows(part=[part], at=[at])

    return dealt.mapInArrow(run, _ROW)


def _ends(b: pa.RecordBatch, part: int, at: int) -> pa.RecordBatch:
    """Rows at a partition's beginning (numbered from at) or end (at = -1)."""
    n = len(b)
    places = pa.array(np.full(n, -1) if at < 0 else np.arange(at, at + n), pa.int64())
    null = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([null, null, pa.array(np.full(n, part), pa.int32()), places, b.column("grp"), b.column("size"), b.column("key"), b.column("vec")], _NAMES)


def _across(found: DataFrame, least: float, window: int, kind: np.dtype) -> DataFrame:
    """Links (a, b) in windows that reach over the ends of partitions: the last rows of a partition meet the first rows of
    those after it, up to a window."""
    counts = {r[0]: r[1] for r in found.where("key IS NULL AND part IS NOT NULL").select("part", "at").collect()}  # one row a partition
    order, reach = sorted(counts), []
    for i, p in enumerate(order):
        upto = 0
        for q in order[i + 1 :]:
            if upto >= window:
                break
            reach.append((p, q, window - upto))
            upto += counts[q]
    spark = found.sparkSession
    names = ("border", "part", "most")
    near = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in reach], pa.int32()) for i, c in enumerate(names)}))
    rows = found.where("key IS NOT NULL")
    heads = rows.where("at >= 0").join(F.broadcast(near), "part").where("at < most").select("border", F.lit(False).alias("tail"), "grp", "size", "key", "vec")
    tails = rows.where("at < 0").select(F.col("part").alias("border"), F.lit(True).alias("tail"), "grp", "size", "key", "vec")

    def compare(t: pa.Table) -> pa.Table:
        tail, size, grp, key = (t.column(c).to_numpy() for c in ("tail", "size", "grp", "key"))
        vecs, out = _vectors(t.column("vec"), kind), []
        for g, n in set(zip(grp[tail].tolist(), size[tail].tolist(), strict=True)):
            a, b = (np.flatnonzero((tail == k) & (grp == g) & (size == n)) for k in (True, False))
            if len(a) and len(b):
                yes = linked(unit(np.stack([vecs[i] for i in a])), unit(np.stack([vecs[i] for i in b])), least)
                out += [(int(key[a[i]]), int(key[b[j]])) for i, j in joining(yes, same=False)]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return heads.union(tails).groupBy("border").applyInArrow(compare, "a long, b long")


def _angles(members: DataFrame, kind: np.dtype) -> DataFrame:
    """class, key and the cosine (to_mean) of each member of members (class, key, vec) with the mean of its class."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(np.stack(_vectors(b.column("vec"), kind))) if len(b) else np.empty((0, 1))
            classes, at = np.unique(b.column("class").to_numpy(), return_inverse=True)
            total = np.zeros((len(classes), x.shape[1]))
            np.add.at(total, at, x)
            yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array([t.tobytes() for t in total], pa.binary())], ["class", "sum"])

    def mean(t: pa.Table) -> pa.Table:
        total = np.sum(_vectors(t.column("sum"), np.dtype(np.float64)), axis=0)
        return pa.table({"class": t.column("class").slice(0, 1), "mean": pa.array([total.tobytes()], pa.binary())})

    def to_mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = unit(np.stack(_vectors(b.column("vec"), kind))), np.stack(_vectors(b.column("mean"), np.dtype(np.float64)))
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("key"), pa.array(np.einsum("ij,ij->i", x, m))], ["class", "key", "to_mean"])

    # sizes of the vectors of a class are equal, but not those of an Arrow batch
    means = members.select("class", "vec").sortWithinPartitions(F.length("vec")).mapInArrow(_by_size(sums), "class long, sum binary").groupBy("class").applyInArrow(mean, "class long, mean binary")
    both = members.join(means, "class").select("class", "key", "vec", "mean").sortWithinPartitions(F.length("vec"))
    return both.mapInArrow(_by_size(to_mean), "class long, key long, to_mean double")


def _by_size(f):
    """f over batches in which all vectors have one size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([len(v) for v in b.column("vec").to_pylist()])
            ends = [0, *(np.flatnonzero(n[1:] != n[:-1]) + 1).tolist(), len(b)]
            yield from (b.slice(lo, hi - lo) for lo, hi in zip(ends[:-1], ends[1:], strict=True) if hi > lo)

    return lambda batches: f(cut(batches))


def links_within(members: DataFrame, least: float, kind: np.dtype, cell: int = CELL) -> DataFrame:
    """key and n, the copies of other members linked with it, for members (class, key, copies, vec): exact, without a limit
    on the size of a class and without its pairs."""
    sizes = stored(members.groupBy("class").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > cell)
    placed = members.join(sizes, "class").select("class", "key", "copies", "vec", F.when(F.col("n") <= cell, 1).otherwise(F.ceil(F.col("n") / cell)).cast("int").alias("blocks"))
    none = members.sparkSession.createDataFrame([], "class long, all_copies long")
    if large.isEmpty():
        placed = placed.withColumn("core", F.lit(False))
    else:
        # two members nearer to the mean than half the angle are linked; a hair less, for the rounding of the mean
        half = cos(acos(least) / 2) + 1e-9
        near = stored(_angles(members.join(large.select("class"), "class").select("class", "key", "vec"), kind).where(F.col("to_mean") >= half).select("class", "key"))
        placed = stored(placed.join(near.select("key", F.lit(True).alias("core")), "key", "left").withColumn("core", F.coalesce("core", F.lit(False))))
        none = placed.where("core").groupBy("class").agg(F.sum("copies").alias("all_copies"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # blocks of the others meet each other and all blocks of the core; those of the core do not meet
    others = placed.where("NOT core").select("class", "block").distinct().groupBy("class").agg(F.collect_list("block").alias("shell"))
    core = placed.where("core").select("class", "block").distinct().groupBy("class").agg(F.collect_list("block").alias("cores"))
    none_of = F.array().cast("array<int>")
    met = placed.join(others, "class").join(core, "class", "left").withColumn("cores", F.coalesce("cores", none_of))
    here, no_core = F.col("block"), F.lit(None).cast("int")

    def cells(core: Column, i: Column, j: Column) -> Column:
        return F.struct(core.alias("core_block"), F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))

    dealt = F.when(F.col("core"), F.transform("shell", lambda s: cells(here, s, s))).otherwise(
        F.concat(F.transform("shell", lambda s: cells(no_core, s, here)), F.transform("cores", lambda c: cells(c, here, here)))
    )
    dealt = met.select("class", "key", "copies", "vec", "core", "block", F.explode(dealt).alias("c")).select("class", "key", "copies", "vec", "core", "block", "c.*")

    def count(t: pa.Table) -> pa.Table:
        x = unit(np.stack(_vectors(t.column("vec"), kind)))
        copies, core, block = t.column("copies").to_numpy(), t.column("core").to_numpy(), t.column("block").to_numpy()
        of_core = t.column("core_block")[0].as_py() is not None
        one = core if of_core else block == block[0]
        a, b = np.flatnonzero(one), np.flatnonzero(~one)
        n = np.zeros(len(x), np.int64)
        if len(b):
            yes = linked(x[a], x[b], least)
            n[a], n[b] = yes @ copies[b], copies[a] @ yes
        else:  # a block with itself
            yes = linked(x, x, least)
            np.fill_diagonal(yes, False)
            n = yes @ copies
        return pa.table({"key": t.column("key"), "n": pa.array(n)})

    met_n = dealt.groupBy("class", "core_block", "i", "j").applyInArrow(count, "key long, n long")
    core_n = placed.where("core").join(none, "class").select("key", (F.col("all_copies") - F.col("copies")).alias("n"))
    return met_n.union(core_n).groupBy("key").agg(F.sum("n").alias("n"))


def embedding_duplicates(rows: DataFrame, *, least: float = SIMILAR, window: int = WINDOW, miss: float = MISS, cell: int = CELL, parts: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of rows (vec_id, embedding, label)."""
    spark = rows.sparkSession
    single = rows.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = np.dtype(np.float32 if single else np.float64)
    ids = F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("id")
    numbers = F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    # what names a vector: hashes of it and its label, or nothing
    name = lambda seed: F.when(usable, F.xxhash64(F.lit(seed), "label", "embedding")).alias(f"h{seed}")
    named = rows.select(ids, F.col("label").cast("string").alias("label"), numbers).select("id", "label", "embedding", name(1), name(2))
    merged = named.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("least_id"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    merged = merged.select(F.monotonically_increasing_id().alias("key"), F.xxhash64("label").alias("grp"), F.size("embedding").alias("size"), "copies", "least_id", "h1", "h2", "embedding")

    distinct = stored(merged)
    by_group = distinct.groupBy("grp", "size").agg(F.count("*").alias("n"))
    largest, in_bytes = by_group.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("size") * kind.itemsize), F.lit(0))).first()
    turns, hashes = passes_for(largest, least, window, miss)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("size").to_numpy()
            keys: list = [None] * len(b)
            raw: list = [None] * len(b)
            flat, ends = b.column("embedding").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                x = flat[ends[at][:, None] + np.arange(n)].astype(kind)
                u = unit(x)
                k = np.stack([hash_keys(u, turn, hashes) for turn in range(turns)], 1)
                for i, row, v in zip(at.tolist(), k, x, strict=True):
                    keys[i], raw[i] = row, v.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("grp"), b.column("size"), b.column("copies"), pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["key", "grp", "size", "copies", "vec", "keys"])

    vectors = stored(distinct.select("key", "grp", "size", "copies", "embedding").mapInArrow(keyed, "key long, grp long, size int, copies long, vec binary, keys array<long>"))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), in_bytes // PART + 1)
    links = None
    for turn in range(turns if largest > 1 else 0):
        # a pass is one job with its own stored result, so a lost executor costs a part of one pass
        found = stored(_one_pass(vectors, turn, parts, least, window, kind))
        both = found.where("a IS NOT NULL").select("a", "b").union(_across(found, least, window, kind))
        links = both if links is None else links.union(both)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    classes = stored(components(links))
    members = classes.join(vectors.select("key", "copies", "vec"), "key").select("class", "key", "copies", "vec")
    counts = links_within(members, least, kind, cell)
    least_ids = classes.join(distinct.select("key", "least_id"), "key").groupBy("class").agg(F.min("least_id").alias("component"))
    known = classes.join(least_ids, "class").join(counts, "key", "left").select("key", "component", "n")
    of_vector = distinct.select("key", "h1", "h2", "copies", "least_id").join(known, "key", "left")
    of_vector = of_vector.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least_id").alias("component"))
    out = named.select("id", "h1", "h2").join(of_vector, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    real = lambda c: F.when(c != LAST, c)
    return out.select(real(F.col("id")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), real(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def op13_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_duplicates": op13_embedding_duplicates}
ORACLE_SQL: dict[str, str] = {}  # compared with a brute-force version in tests/llm
