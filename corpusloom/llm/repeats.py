"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored greedily against the documents before it (smaller doc_id). The reference is indexed in blocks:
a block holds all phrase starts of the corpus whose hash falls into it, so each phrase meets every place where it occurs,
in one block, wherever the two documents lie, and gets the earliest of them: the document and the place in it. A factor
(start, words, source, place) runs on as long as the next phrase of the document is the next phrase of the source too, so
its words stand in the source at that place. Where one ends, the phrases across the boundary have been looked up as well,
so that a repeat that changes its source or jumps in it is not lost; neighbouring factors overlap there.
Factors of WINDOW words and more are duplicate spans; their words are removed. Windows are judged on the input.

Two rounds keep what is moved small. First only anchors are sent (the least hash among the ANCHOR-word runs of each
window, so equal windows have equal anchors); then only windows whose anchor lies in two documents are looked up. Before
they are sent, equal hashes are merged in each chunk or bucket, so a passage in a third of all documents is a few rows to
a block, not one a document. Texts are shuffled once, compressed, into buckets by doc_id.

Nulls, ties and odd input: a null text has no words; texts under WINDOW words stay whole; a null doc_id counts as the
largest; rows that repeat a doc_id each get a row and never remove each other's words (only a smaller doc_id does), and a
factor with such a source may have its phrases in several of its rows; a phrase that its source repeats has its first
place there; an empty table gives no rows; only doc_id and text are read. Windows are compared by 64-bit hashes within a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, bounded_batches, grams, mixed, table

WINDOW, ANCHOR = 13, 5
#: Bytes of text of a bucket of documents (on average) and of a chunk of a scan (at most, but for one longer document).
BUCKET, CHUNK = 10_000_000, 16_000_000
LAST = 2**63 - 1
_SALT = np.uint64(0x5851F42D4C957F2D)


class Phrases:
    """The words of some documents in a row, with the hashes of all windows inside a document."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, window: int = WINDOW):
        self.words = [t.split() for t in texts]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.h = np.concatenate([hashes.of(w) for w in self.words]) if texts else np.empty(0, np.uint64)
        own = np.repeat(np.arange(len(texts)), np.maximum(self.lengths - window + 1, 0))
        # start of each window in its document and in the row of all words, and its document
        self.doc = own
        runs = np.maximum(self.lengths - window + 1, 0)
        self.place = np.arange(len(own)) - np.repeat(np.cumsum(runs) - runs, runs)
        self.start = self.place + self.first[own]
        self.window = window

    def hashes(self) -> np.ndarray:
        return grams(self.h, self.window)[self.start]

    def anchors(self) -> np.ndarray:
        a = grams(self.h, ANCHOR)
        m = len(self.h) - self.window + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        least = a[:m].copy()
        for j in range(1, self.window - ANCHOR + 1):
            np.minimum(least, a[j : j + m], out=least)
        return least[self.start]


def _split(key: np.ndarray, *cols: np.ndarray) -> Iterator[tuple]:
    """(key, columns of its rows) for each distinct key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.diff(key)) + 1
    for i, part in enumerate(np.split(order, cut)):
        if len(part):
            yield (key[0 if i == 0 else cut[i - 1]], *[c[part] for c in cols])


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(h ^ _SALT) % np.uint64(blocks)).astype(np.int64)


def _rows(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows, fields)])


_ANCHORS = [("block", pa.int64()), ("known", pa.bool_()), ("hashes", pa.binary()), ("tags", pa.binary())]
_SHARED = [("bucket", pa.int64()), ("hashes", pa.binary())]
_WINDOWS = [("block", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())]
_EARLIER = [("bucket", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())]


def _ddl(fields: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {({'int64': 'long', 'bool': 'boolean'}).get(str(t), str(t))}" for n, t in fields)


def _u8(col: pa.ChunkedArray, kind: type = np.uint64) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in col.to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _chunk_anchors(texts: list[bytes], buckets: np.ndarray, blocks: int, hashes: WordHashes) -> pa.RecordBatch:
    """Anchors of a chunk of documents, each once: with its bucket if it lies in one document, else with tag -1; then the
    buckets concerned already know that it is shared, and are told so (known) by way of any block."""
    ph = Phrases(texts, hashes)
    a, d = ph.anchors(), ph.doc
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    a, d = a[new], d[new]
    order = np.argsort(a, kind="stable")  # documents stay in order within a hash
    a, d = a[order], d[order]
    head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    tail = np.concatenate([head[1:], [len(a)]]) - 1 if len(head) else head
    many = d[head] != d[tail]
    tag = np.where(many, -1, buckets[d[head]]) if len(head) else np.empty(0, np.int64)
    out = [(b, False, x.tobytes(), t.astype(np.int64).tobytes()) for b, x, t in _split(_block(a[head], blocks), a[head], tag)]
    inside = np.repeat(many, tail - head + 1)
    for bucket, x in _split(buckets[d[inside]], a[inside]):
        out.append((int(bucket) % blocks, True, np.unique(x).tobytes(), np.array([bucket], np.int64).tobytes()))
    return _rows(out, _ANCHORS)


def _match_anchors(t: pa.Table) -> pa.Table:
    """In one block: the anchors that lie in two documents, for each bucket that has them."""
    known = t.column("known").to_pylist()
    fresh = t.filter(pa.array([not k for k in known]))
    told = t.filter(pa.array(known))
    out = [(int(np.frombuffer(g, np.int64)[0]), x) for g, x in zip(told.column("tags").to_pylist(), told.column("hashes").to_pylist(), strict=True)]
    a, tag = _u8(fresh.column("hashes")), _u8(fresh.column("tags"), np.int64)
    if len(a):
        _, inv, n = np.unique(a, return_inverse=True, return_counts=True)
        shared = n > 1
        shared[inv[tag < 0]] = True
        keep = shared[inv] & (tag >= 0)
        out += [(int(b), x.tobytes()) for b, x in _split(tag[keep], a[keep])]
    return _table(out, _SHARED)


def _texts(t: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Documents of a bucket in order of doc_id."""
    ids = t.column("key").to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    packed = t.column("packed").to_pylist()
    return ids[order], [zstandard.decompress(packed[i]) for i in order], order


def _candidates(bucket: int, docs: pa.Table, shared: pa.Table, blocks: int) -> pa.Table:
    """Windows of a bucket whose anchor is shared, each once, with the first document of the bucket that has it and the
    first place there."""
    if not len(docs) or not len(shared):
        return _table([], _WINDOWS)
    ids, texts, _ = _texts(docs)
    ph = Phrases(texts, WordHashes(300_000))
    at = np.flatnonzero(np.isin(ph.anchors(), np.unique(_u8(shared.column("hashes")))))
    h, first = np.unique(ph.hashes()[at], return_index=True)
    first = at[first]
    parts = _split(_block(h, blocks), h, ids[ph.doc[first]], ph.place[first])
    return _table([(int(b), bucket, x.tobytes(), d.tobytes(), p.tobytes()) for b, x, d, p in parts], _WINDOWS)


def _match_windows(t: pa.Table) -> pa.Table:
    """In one block: for each bucket, its windows that start in an earlier document elsewhere, with that document and the
    place in it."""
    h, d, p = _u8(t.column("hashes")), _u8(t.column("docs"), np.int64), _u8(t.column("places"), np.int64)
    bucket = np.repeat(t.column("bucket").to_numpy(), [len(x) // 8 for x in t.column("hashes").to_pylist()])
    order = np.lexsort((p, d, h))
    h, d, p, bucket = h[order], d[order], p[order], bucket[order]
    head = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
    group = np.cumsum(head) - 1
    first, place = d[head][group], p[head][group]
    later = first < d
    parts = _split(bucket[later], h[later], first[later], place[later])
    return _table([(int(b), x.tobytes(), s.tobytes(), a.tobytes()) for b, x, s, a in parts], _EARLIER)


def parse(source: np.ndarray, place: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, source, place) from the earliest source of each window start of a document (LAST:
    none) and its place there: a factor takes the next window as long as it is the next one of its source."""
    if not len(source):
        return []
    leaves = (np.diff(source) != 0) | (np.diff(place) != 1)
    cut = np.concatenate([[0], np.flatnonzero(leaves) + 1, [len(source)]])
    starts = cut[:-1]
    found = zip(starts.tolist(), np.diff(cut).tolist(), source[starts].tolist(), place[starts].tolist(), strict=True)
    return [(a, n + window - 1, s, p) for a, n, s, p in found if s != LAST]


def _factored(docs: pa.Table, earlier: pa.Table) -> tuple[np.ndarray, list[tuple]]:
    ids, texts, order = _texts(docs)
    ph = Phrases(texts, WordHashes(300_000))
    h, own = ph.hashes(), ids[ph.doc]
    each, at, inv = np.unique(h, return_index=True, return_inverse=True)
    first, where = own[at], ph.place[at]  # documents are in order, so this is the first of the bucket
    if len(earlier) and len(each):
        eh, ed, ep = _u8(earlier.column("hashes")), _u8(earlier.column("docs"), np.int64), _u8(earlier.column("places"), np.int64)
        i = np.searchsorted(each, eh)  # each hash is there once for a bucket
        less = ed < first[i]
        first[i[less]], where[i[less]] = ed[less], ep[less]
    source = np.where(first[inv] < own, first[inv], LAST)
    place = where[inv]
    ends = np.cumsum(np.maximum(ph.lengths - WINDOW + 1, 0))
    rows = []
    for j, words in enumerate(ph.words):
        mine = slice(ends[j - 1] if j else 0, ends[j])
        factors = parse(source[mine], place[mine])
        gone = np.zeros(len(words), bool)
        for a, n, *_ in factors:
            gone[a : a + n] = True
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if factors else words
        rows.append((len(words), int(gone.sum()), b" ".join(kept), [{"start": a, "words": n, "source": s, "place": p} for a, n, s, p in factors]))
    return ids, rows


_FACTOR = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64()), ("place", pa.int64())])
_OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("factors", pa.list_(_FACTOR))]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and factors (start, words, source doc_id,
    place: the word of the source at which they stand)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET + 1)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(parts)))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, texts, buckets, n = WordHashes(500_000), [], [], 0
        for b in batches:
            for t, k in zip(b.column("text").to_pylist(), b.column("bucket").to_pylist(), strict=True):
                texts.append(t)
                buckets.append(k)
                n += len(t)
                if n > CHUNK:
                    yield _chunk_anchors(texts, np.array(buckets, np.int64), parts, hashes)
                    texts, buckets, n = [], [], 0
        if texts:
            yield _chunk_anchors(texts, np.array(buckets, np.int64), parts, hashes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("key"), pa.array(list(map(pack, b.column("text").to_pylist())), pa.binary())], ["bucket", "key", "packed"])

    def candidates(key: tuple, d: pa.Table, s: pa.Table) -> pa.Table:
        return _candidates(key[0].as_py(), d, s, parts)

    def factored(d: pa.Table, e: pa.Table) -> pa.Table:
        if not len(d):
            return _table([], _OUT)
        ids, out = _factored(d, e)
        return _table([(i, *r) for i, r in zip(ids.tolist(), out, strict=True)], _OUT)

    texts = rows.mapInArrow(packed, "bucket long, key long, packed binary").repartition(parts, "bucket")
    found = rows.select("text", "bucket").mapInArrow(anchors, _ddl(_ANCHORS))
    shared = found.groupBy("block").applyInArrow(_match_anchors, _ddl(_SHARED))
    windows = texts.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(candidates, _ddl(_WINDOWS))
    earlier = windows.groupBy("block").applyInArrow(_match_windows, _ddl(_EARLIER))
    out = texts.groupBy("bucket").cogroup(earlier.groupBy("bucket")).applyInArrow(factored, "doc_id long, n_words long, n_removed long, kept binary, factors array<struct<start:long,words:long,source:long,place:long>>")
    return out.select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), "factors")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"), F.size("factors").cast("long").alias("n_factors"))


QUERIES = {"op1_repeats": op1_repeats}
ORACLE_SQL: dict[str, str] = {}  # a brute-force version in tests/llm
