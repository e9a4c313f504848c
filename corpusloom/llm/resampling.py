"""Target-distribution importance resampling over hashed word features, by a vectorised byte automaton.

Texts are not split into strings. The UTF-8 bytes of an Arrow batch of texts are classified by a table of 256 entries, word
boundaries are the differences between neighbouring classes, and the table-driven CRCs of all words are advanced together,
one byte of each at a step; runs of several words go on from the states of their first words. What a step costs is in
proportion to the words that are still open, and words over LONG bytes are finished one by one, so a long word is no loop
of steps over few words.

Two scans of the texts: the first adds bucket counts up in each task and sends them once, so at most tasks * buckets rows
are shuffled however hot a word is; the second looks each feature's gain up in the table made of them. The draw is a Gumbel
top-k: score = weight + noise, the highest scores are taken without a global sort in one task (sampled ranges and exact
ranks inside them).

The driver holds one number for each bucket, a fixed parameter. Sums and ranks are exact and cover all rows.

Nulls, ties and odd input: a null text has no words (no features, weight 0, never drawn); a null doc_id hashes as an empty
string and counts as the largest in ties; rows that repeat a doc_id have equal noise, each gets a row, and equal ones take
neighbouring ranks; an empty table gives no rows; with an empty target all gains come from the documents alone; only doc_id
and text are read, so other columns cannot clash. Texts are whole, however long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import blank_if_null, bounded_batches, stored, table
from .ranges import ranges_for, sampled_splitters, with_offsets

#: Words in a feature at most, buckets, least words of a document to be drawn, percentage drawn, and seed of the noise.
WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of a word that are advanced together with the other words.
LONG = 64
LAST = 2**63 - 1

_byte = np.arange(256, dtype=np.uint8)
#: Bytes that stand in words: digits, letters and all bytes of characters beyond ASCII.
IN_WORD = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte | 0x20) >= 0x61) & ((_byte | 0x20) <= 0x7A) & (_byte < 0x80) | (_byte >= 0x80)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 0x20, _byte).astype(np.uint8)


def _crc_table() -> np.ndarray:
    """Remainders of the bytes under the reflected polynomial of CRC-32."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC states after the bytes data[start : start + size] of each word."""
    order = np.argsort(-size, kind="stable")
    s, at, left = state[order], start[order], size[order]
    upto = np.searchsorted(-left, -np.arange(1, min(int(left[0]) if len(left) else 0, LONG) + 1), "right")
    for k, m in enumerate(upto.tolist()):  # the words longer than k bytes are the first m
        s[:m] = _step(s[:m], data[at[:m] + k])
    for i in range(int(np.searchsorted(-left, -LONG, "left"))):
        rest = data[at[i] + LONG : at[i] + left[i]].tobytes()
        s[i] = np.uint32(zlib.crc32(rest, int(s[i] ^ _ALL))) ^ _ALL
    out = np.empty_like(s)
    out[order] = s
    return out


def word_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts in a row; start, size and text number of each word."""
    texts = texts.cast(pa.large_string())
    _, offsets, values = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(values or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = IN_WORD[raw]
    # a word starts after another class or a text's start, and ends before another class or a text's end
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first, last = ends[:-1][ends[:-1] < ends[1:]], ends[1:][ends[:-1] < ends[1:]] - 1
    opens[first], closes[last] = inside[first], inside[last]
    start = np.flatnonzero(opens)
    return LOWER[raw], start, np.flatnonzero(closes) + 1 - start, np.searchsorted(ends, start, "right") - 1


def features(texts: pa.Array, words: int = WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; text number and bucket of each feature (a run of 1 to ``words`` words, joined by one space)."""
    data, start, size, doc = word_places(texts)
    state = advance(np.full(len(start), _ALL), data, start, size)
    docs, found = [doc], [state ^ _ALL]
    for n in range(1, words):
        same = doc[n:] == doc[: len(doc) - n] if n < len(doc) else np.empty(0, bool)
        at = np.flatnonzero(same)  # first words of runs of n + 1 words
        state = state[: len(same)][same] if n == 1 else state[np.isin(kept, at, assume_unique=True)]
        kept = at
        state = advance(_step(state, np.full(len(at), 0x20, np.uint8)), data, start[at + n], size[at + n])
        docs.append(doc[at])
        found.append(state ^ _ALL)
    return np.bincount(doc, minlength=len(texts)), np.concatenate(docs), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            n += np.bincount(features(b.column("text"), words, buckets)[2], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = docs.select(blank_if_null().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in counted.collect():  # one row a bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed bucket frequencies, floored."""
    k, a, b = len(source), int(source.sum()), int(target.sum())
    return np.array([floor(1000 * log((t + 1) * (a + k) / ((s + 1) * (b + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def resample(
    docs: DataFrame, target: DataFrame, *, words: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, ranges: int | None = None
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (1 for the highest score; null if not drawn) for each row of docs."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)
    bounded_batches(spark)
    gain = gains(bucket_counts(docs, words, buckets), bucket_counts(target, words, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, doc, bucket = features(b.column("text"), words, buckets)
            weight = np.zeros(len(b), np.int64)
            np.add.at(weight, doc, gain[bucket])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(arrow_kind), pa.array(n.astype(np.int64)), pa.array(np.bincount(doc, minlength=len(b)).astype(np.int64)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    weighed = docs.select("doc_id", blank_if_null().alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), blank_if_null("doc_id")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = stored(
        weighed.withColumn("score", F.col("weight") + noise)
        .withColumn("_first", -F.col("score"))
        .withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
        .withColumn("_place", F.monotonically_increasing_id())
    )
    able = rows.where(F.col("n_words") >= least_words).withColumn("_one", F.lit(1).cast("long"))
    n = able.count()
    drawn, keys = percent * n // 100, ("_first", "_id", "_place")
    cells = min(ranges_for(n), max(1, n // 1000)) if ranges is None else ranges
    placed = with_offsets(able, keys, "_one", sampled_splitters(able, keys, "_one", cells))
    rank = F.when(F.col("_rank") < drawn, F.col("_rank") + 1).cast("long").alias("rank")
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    return placed.select(*out, rank).union(rows.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_resampling": op12_resampling}
ORACLE_SQL: dict[str, str] = {}  # DuckDB has no crc32; tests/llm compares with a brute-force version
