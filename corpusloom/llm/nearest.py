"""MinHash near-dedup with DartMinHash signatures.

Documents are weighted sets of word shingles. Darts fall on the plane of (weight, rank) of each element, a Poisson number
in each cell, all drawn from hashes of the element; those under the element's weight count. Each dart belongs to one of
the signature's coordinates, and the dart of least rank is kept there. Darts are thrown band of ranks by band of ranks, up
to a rank at which the coordinates are expected to be full, further only for documents with an empty one. Two documents
agree in a coordinate with a probability equal to their (weighted) Jaccard similarity. Weights are 1 by default, which
gives the similarity of shingle sets; ``weighted`` takes the number of occurrences.

Joining is banded. Equal shingle sets are merged first, so copies cost one signature. Each bucket has a leader. First each
document is compared with the least of its leaders alone. Buckets whose members are not in one class after that are
compared within, so no pair that shares a bucket and lies in two classes goes untested: a bucket is cut into blocks of
bounded size, each two blocks meet in one cell, and a cell returns at most one link for each document, never its pairs.
Candidates are verified on the texts: similarity of the exact shingle sets. Classes are the connected components of the
links (large-star and small-star steps on tables, one stored table a step).

Skew: bucket leaders and component minima come from aggregates with a map-side combine; the joins back to the members are
plain joins, whose skewed partitions the engine splits; cells are bounded in shingles. What is stored is what several jobs
read: signatures, members of shared buckets, packed texts and links.

Nulls, ties and odd input: null texts and texts without words are each a class of their own; a text of fewer than SHINGLE
words is one shingle; each shingle set has a key of its own, so rows that share a doc_id, or have none, are all compared;
rows with words that share a doc_id are linked and share a class; rows without doc_id are not linked by that, and their
doc_id counts as the largest; the class id is the least doc_id of the class (null if none has one); an empty table gives
no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, factorial, log

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, bounded_batches, grams, mixed, release_memory, released, stored, table

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
K = BANDS * ROWS
#: Ranks below this are one cell of an element; above it cells double up to 1.
LOWEST_CELL = 2.0**-6
#: A document and its leader whose signatures agree less are not verified then (7 standard deviations under SIMILAR); if
#: they stay in two classes, their bucket is compared within, whatever the signatures say.
LEAST_AGREEMENT = 0.55
#: Shingles of a block of a bucket, at least and at most (but for one larger document); between them, a quarter of the bucket.
LEAST_BLOCK, MOST_BLOCK = 16_000, 2_000_000
#: Documents whose darts are thrown together: the ranks that a short one needs are gone through once for all of them.
TOGETHER = 500
LAST = 2**63 - 1
_C = np.uint64(0xD1342543DE82EF95)
_TO_UNIT = 2.0**-64
_hashes = WordHashes(50_000)


def shingles(words: list[bytes], hashes: WordHashes, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text (sorted hashes) and how often each occurs."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = hashes.of(words)
    return np.unique(grams(h, min(n, len(h))), return_counts=True)


def _cells(top: float) -> Iterator[tuple[int, float, float]]:
    """(number, low, high) of the rank cells that begin below top."""
    low, high, i = 0.0, LOWEST_CELL, 0
    while low < top:
        yield i, low, high
        low, i = high, i + 1
        high = high * 2 if high < 1 else high + 1


def _counts(u: np.ndarray, area: float) -> np.ndarray:
    """Poisson numbers by inversion."""
    upto = np.cumsum([exp(-area) * area**i / factorial(i) for i in range(14)])
    return np.searchsorted(upto, u, "right")


def dart_signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = K) -> np.ndarray:
    """One row of k 32-bit dart numbers for each non-empty set of 64-bit element hashes."""
    n = len(sets)
    total = np.array([len(s) if weights is None else float(weights[i].sum()) for i, s in enumerate(sets)])
    order = np.argsort(total, kind="stable")  # then the sets that need a cell are the first ones
    best = np.full((n, k), ~np.uint64(0))
    top = (k * log(k) + 2 * k) / np.maximum(total, 1e-9)
    low = np.zeros(n)
    active = order
    while len(active):
        el = np.concatenate([sets[i] for i in active])
        wt = None if weights is None else np.concatenate([weights[i] for i in active]).astype(float)
        lens = np.array([len(sets[i]) for i in active])
        own = np.repeat(active, lens)
        ends = np.cumsum(lens)
        least = low[active].min()
        for cell, a, b in _cells(top[active].max()):
            if b <= least:
                continue
            upto = ends[np.searchsorted(-top[active], -a, "left") - 1] if top[active[0]] > a else 0
            layers = 1 if wt is None else int(ceil(wt[:upto].max(initial=1)))
            for layer in range(layers):
                seed = mixed(np.array([(cell * 4096 + layer + 1) & (2**64 - 1)], np.uint64) * _C)[0]
                h = mixed(el[:upto] ^ seed)
                number = _counts(h * _TO_UNIT, b - a)
                hit = np.flatnonzero(number)
                while len(hit):
                    d = mixed(h[hit] + number[hit].astype(np.uint64) * _C)
                    rank = a + (b - a) * (d >> np.uint64(11)) * 2.0**-53
                    e = mixed(d ^ _C)
                    doc = own[hit]
                    ok = (rank < top[doc]) & (rank >= low[doc])
                    if wt is not None:
                        ok &= layer + (mixed(e + _C) * _TO_UNIT) < wt[hit]
                    value = rank[ok].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (e[ok] >> np.uint64(32))
                    np.minimum.at(best.ravel(), doc[ok] * k + (e[ok] % np.uint64(k)).astype(np.int64), value)
                    number[hit] -= 1
                    hit = hit[number[hit] > 0]
        left = (best[active] == ~np.uint64(0)).any(1)
        active = active[left]
        low[active] = top[active]
        top[active] *= 2
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _digests(b: pa.RecordBatch) -> pa.Array:
    return pa.array(list(map(xxhash.xxh3_128_digest, b.column("text").to_pylist())), pa.binary())


def signed(docs: DataFrame, *, weighted: bool = False) -> DataFrame:
    """id, digest (of the text), n_shingles, set (hash of the shingle set, null without words) and sig (array of int, null
    without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(100_000)
        for whole in batches:
            for lo in range(0, len(whole), TOGETHER):
                b = whole.slice(lo, TOGETHER)
                each = [shingles(t.split(), hashes) for t in b.column("text").to_pylist()]
                full = [i for i, (s, _) in enumerate(each) if len(s)]
                sig = dart_signatures([each[i][0] for i in full], [each[i][1] for i in full] if weighted else None) if full else np.empty((0, K), np.uint32)
                names: list[bytes | None] = [None] * len(each)
                sigs: list[np.ndarray | None] = [None] * len(each)
                for j, i in enumerate(full):
                    names[i] = xxhash.xxh3_128_digest(each[i][0].tobytes() + (each[i][1].tobytes() if weighted else b""))
                    sigs[i] = sig[j].view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), _digests(b), pa.array([len(s) for s, _ in each], pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))],
                    ["id", "digest", "n_shingles", "set", "sig"],
                )

    return docs.mapInArrow(released(run), "id long, digest binary, n_shingles long, set binary, sig array<int>")


def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough coordinates."""
    both = pairs.join(sigs.select(F.col("key").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("sb")), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))
    return both.where(same >= LEAST_AGREEMENT * K).select("a", "b")


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], weighted: bool = False) -> float:
    """Exact Jaccard similarity of two non-empty shingle sets, with occurrences as weights if asked for."""
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not weighted:
        return len(both) / (len(x[0]) + len(y[0]) - len(both))
    least = int(np.minimum(x[1][i], y[1][j]).sum())
    return least / (int(x[1].sum()) + int(y[1].sum()) - least)


def _similar(pairs: DataFrame, packed: DataFrame, least: float, weighted: bool) -> DataFrame:
    """Pairs whose exact shingle sets have at least the similarity ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(150_000)
        cached: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def of(key: int, z: bytes) -> tuple[np.ndarray, np.ndarray]:
            if key not in cached:
                if len(cached) > 64:
                    cached.clear()
                cached[key] = shingles(zstandard.decompress(z).split(), hashes)
            return cached[key]

        for t in batches:
            keep = []
            for a, b, pa_, pb in zip(*(t.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                keep.append(similarity(of(a, pa_), of(b, pb), weighted) >= least)
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(packed.select(F.col("key").alias("b"), F.col("packed").alias("tb")), "b").join(packed.select(F.col("key").alias("a"), F.col("packed").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(released(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """key, class (least key of its component) for every key in links (a, b), by large-star and small-star steps."""
    edges = stored(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u != v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("key"), F.col("v").alias("class")).union(edges.select(F.col("v").alias("key"), F.col("v").alias("class")).distinct())


def linked_in_cell(keys: list[int], classes: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between documents of different classes (and blocks, if there are two), as few as join the same classes."""
    n = len(keys)
    size = np.array([len(x) for x in sets])
    h, own = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    two = bool((blocks != blocks[0]).any())
    _, now, each = np.unique(classes, return_inverse=True, return_counts=True)
    links = []
    for x in np.flatnonzero(now != each.argmax()):  # of two documents in different classes, one is not in the largest
        lo, hi = np.searchsorted(h, sets[x], "left"), np.searchsorted(h, sets[x], "right")
        runs = hi - lo
        at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(lo, runs)
        both = np.bincount(own[at], minlength=n)
        ok = (both >= least * (size + size[x] - both)) & (now != now[x])
        if two:
            ok &= blocks != blocks[x]
        for c, y in dict(zip(now[ok].tolist(), np.flatnonzero(ok).tolist(), strict=True)).items():
            links.append((keys[x], keys[y]))
            now[now == c] = now[x]
    return links


def _linked_in_buckets(left: DataFrame, packed: DataFrame, sizes: DataFrame, least: float, weighted: bool) -> DataFrame:
    """Links (a, b) between members (bucket, key, class) of a bucket in different classes; sizes: key, n_shingles."""

    def elements(z: bytes) -> np.ndarray:
        h, n = shingles(zstandard.decompress(z).split(), _hashes)
        if not weighted:
            return h
        # the i-th occurrence of a shingle is an element of its own
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return mixed(np.repeat(h, n) + i.astype(np.uint64) * _C)

    def link(t: pa.Table) -> pa.Table:
        sets = [elements(z) for z in t.column("packed").to_pylist()]
        found = linked_in_cell(t.column("key").to_pylist(), t.column("class").to_numpy(), t.column("block").to_numpy(), sets, least)
        del sets
        release_memory()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    total = F.sum("n_shingles")
    block = F.least(F.greatest(total / 4, F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))
    blocks = left.join(sizes, "key").groupBy("bucket").agg(F.ceil(total / block).cast("int").alias("blocks"))
    placed = left.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "class")
    # a text is a third of its shingles' hashes, so texts travel and are cut into shingles in each cell
    return cells.join(packed, "key").groupBy("bucket", "i", "j").applyInArrow(link, "a long, b long").distinct()


def _open(members: DataFrame, classes: DataFrame) -> DataFrame:
    """bucket, key, class of the members of buckets with more than one class."""
    rows = members.join(classes, "key", "left").select("bucket", "key", F.coalesce("class", "key").alias("class"))
    mixed_ = rows.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("bucket")
    return stored(rows.join(mixed_, "bucket"))


def _sharing_ids(signs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Links (a, b) between the shingle sets of rows that share a doc_id."""
    full = signs.where((F.col("id") != LAST) & F.col("set").isNotNull()).select("id", "set")
    repeated = full.groupBy("id").agg(F.count("*").alias("n"), F.min("set").alias("one")).where("n > 1").select("id", "one")
    key = sigs.select("set", "key")
    return (
        full.join(repeated, "id").where("set != one").select("one", "set").distinct()
        .join(key.select(F.col("set").alias("one"), F.col("key").alias("a")), "one").join(key.withColumnRenamed("key", "b"), "set").select("a", "b")
    )


def near_duplicates(docs: DataFrame, *, least: float = SIMILAR, weighted: bool = False) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and n_shingles for each row of docs."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    bounded_batches(docs.sparkSession)
    signs = stored(signed(rows, weighted=weighted))
    # copies: one key and one representative (its id and the digest of its text) for each shingle set
    first = signs.where("set IS NOT NULL").groupBy("set").agg(F.min(F.struct("id", "digest", "n_shingles", "sig")).alias("m"))
    sigs = stored(first.select(F.monotonically_increasing_id().alias("key"), "set", F.col("m.id").alias("rep"), "m.digest", "m.n_shingles", "m.sig"))
    band = F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.slice("sig", i * ROWS + 1, ROWS)) for i in range(BANDS)])).alias("i", "bucket")
    banded = sigs.select("key", band).select("key", "bucket")
    # buckets of two and more
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("lead")).where("n > 1")
    members = stored(banded.join(shared, "bucket").select("key", "bucket", "lead"))
    wanted = members.select("key").distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = zstandard.ZstdCompressor(3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), _digests(b), pa.array(list(map(of, b.column("text").to_pylist())), pa.binary())], ["id", "digest", "packed"])

    own = sigs.select("key", F.col("rep").alias("id"), "digest").join(wanted, "key", "left_semi")
    packed = rows.mapInArrow(released(pack), "id long, digest binary, packed binary").join(own, ["id", "digest"])
    packed = stored(packed.select("key", "packed").dropDuplicates(["key"]))

    nearest = members.where("key != lead").groupBy(F.col("key").alias("b")).agg(F.min("lead").alias("a")).select("a", "b")
    classes = components(_similar(_agreeing(nearest, sigs), packed, least, weighted).union(_sharing_ids(signs, sigs)))
    left = _open(members.select("key", "bucket"), classes)
    if not left.isEmpty():
        found = _linked_in_buckets(left, packed, sigs.select("key", "n_shingles"), least, weighted)
        classes = components(found.union(classes.select(F.col("class").alias("a"), F.col("key").alias("b"))))
    named = classes.join(sigs.select("key", "rep"), "key")
    least_id = named.groupBy("class").agg(F.min("rep").alias("least_id"))
    of_set = sigs.select("key", "set", "rep").join(named.join(least_id, "class").select("key", "least_id"), "key", "left")
    out = signs.select("id", "n_shingles", "set").join(of_set.select("set", F.coalesce("least_id", "rep").alias("class")), "set", "left")
    id_ = lambda c: F.when(c != LAST, c)
    return out.select(id_(F.col("id")).alias("doc_id"), id_(F.coalesce("class", "id")).alias("class_id"), "n_shingles")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_near_duplicates": op8_near_duplicates}
ORACLE_SQL: dict[str, str] = {}  # a brute-force version in tests/llm
