"""Token counts without token ids.

A text is cut into pre-tokens, each a run of spaces and the run of other characters after it. No piece of the vocabulary
holds a space mark after another character (checked when the model is loaded), so no merge crosses these cuts and the
counts add up. With a vocabulary of another kind a whole text is one pre-token.

Texts are cut in blocks of at most BLOCK characters (but for one longer text). Pre-tokens that are pieces of the
vocabulary, which is fixed and small, are counted once when the model is loaded and added up where they stand. Of all
others a block sends the distinct ones to slots by hash, packed. A slot counts each distinct pre-token of the corpus once
and sends the counts back to the blocks that asked, where they are joined to the frequencies in each document and summed.
So a frequent pre-token is sent once by a block, not by each document, its frequencies never meet in one task, and no ids
are kept. The texts are scanned twice rather than stored in between; a block is named by its task and its number in it,
so docs should be a table or a plan whose rows come in the same order when a lost task runs again (an error if not: digests
of each block's pre-tokens by slot are sent with the counts and compared).

Nulls, ties and odd input: a null text counts as empty (0 bytes, 0 tokens); repeated rows each get a row; an empty table
gives no rows; only doc_id and text are read, so other columns cannot clash. Memory is bounded by a block, the vocabulary
and a slot, whose number grows with the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters and documents of a block, at most (but for one longer text).
BLOCK, MOST_DOCS = 4_000_000, 60_000
#: Bytes of text for each slot.
SLOT = 16_000_000
_MARK = "▁"
_CUT = re.compile(r" *[^ ]+| +")


class PieceCounter:
    """Counts pieces of a sentencepiece model in pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # then a text can be cut before each run of spaces
        self.cuts = not any(_MARK in p.lstrip(_MARK) for p in pieces) and self.model.normalize("  ﬁ ") == f"{_MARK * 3}ﬁ{_MARK}"
        words = [p.lstrip(_MARK) for p in pieces]
        self.known = dict(zip(words, self.counts(words), strict=True))
        # a space at the end of a text: a pre-token of which nothing is left without its first space
        self.known[""] = len(self.model.encode("x ")) - len(self.model.encode("x")) if self.cuts else 0

    def cut(self, text: str) -> list[str]:
        """Pre-tokens. The library puts one space before a text, so each later one stands without its first space."""
        if not self.cuts:
            return [text]
        parts = _CUT.findall(text.replace(_MARK, " "))
        return parts[:1] + [p[1:] for p in parts[1:]]

    def counts(self, parts: list[str]) -> list[int]:
        return [len(x) for lo in range(0, len(parts), 20_000) for x in self.model.encode(parts[lo : lo + 20_000], num_threads=1)]

    def block(self, texts: list[str], slots: int) -> "Block":
        cut: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            cut += self.cut(t)
            ends[i + 1] = len(cut)
        get = self.known.get
        n = np.fromiter((get(p, -1) for p in cut), np.int64, len(cut))
        new = np.flatnonzero(n < 0)
        n[new] = 0
        upto = np.concatenate([[0], np.cumsum(n)])
        code: dict[str, int] = {}
        codes = np.fromiter((code.setdefault(cut[i], len(code)) for i in new.tolist()), np.int64, len(new))
        slot = np.fromiter((xxhash.xxh3_64_intdigest(p) % slots for p in code), np.int64, len(code))
        parts = pa.array(list(code), pa.large_string())
        order = pc.sort_indices(pa.table({"slot": slot, "part": parts}), [("slot", "ascending"), ("part", "ascending")])
        rank = np.empty(len(code), np.int64)
        rank[order.to_numpy()] = np.arange(len(code))
        doc = np.searchsorted(ends, new, side="right") - 1
        pairs, times = np.unique(rank[codes] * len(texts) + doc, return_counts=True)
        per_part = np.bincount(pairs // max(len(texts), 1), minlength=len(code))
        return Block(upto[ends[1:]] - upto[ends[:-1]], slot[order.to_numpy()], parts.take(order), per_part, pairs % max(len(texts), 1), times)


class Block(NamedTuple):
    """Pieces of each text in known pre-tokens; the other distinct pre-tokens by slot and name, each with its number of
    (document, times) rows."""

    base: np.ndarray
    slot: np.ndarray
    parts: pa.LargeStringArray
    per_part: np.ndarray
    doc: np.ndarray
    times: np.ndarray

    def total(self, n: np.ndarray) -> np.ndarray:
        """Pieces of each text, given those of each distinct pre-token."""
        return self.base + np.bincount(self.doc, np.repeat(n, self.per_part) * self.times, len(self.base)).astype(np.int64)


def _packed(a: np.ndarray, kind: type = np.uint32) -> bytes:
    return zstandard.compress(a.astype(kind).tobytes(), 1)


def _unpacked(b: bytes, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _packed_strings(parts: pa.LargeStringArray) -> tuple[bytes, bytes]:
    """Bytes of each string, and all strings in a row."""
    raw = parts.cast(pa.large_binary())
    return _packed(pc.binary_length(raw).to_numpy()), zstandard.compress(b"".join(raw.to_pylist()), 1)


def _unpacked_strings(lengths: np.ndarray, data: list[bytes]) -> pa.LargeStringArray:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(map(zstandard.decompress, data)))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most BLOCK characters and MOST_DOCS rows (but for one longer text), however the
    batches that come are cut."""
    held: list[pa.RecordBatch] = []
    n = rows = 0
    for f in batches:
        lo = 0
        for i, t in enumerate(f.column("text").to_pylist()):
            if rows and (n + len(t) > BLOCK or rows == MOST_DOCS):
                yield _one([*held, f.slice(lo, i - lo)])
                held, lo, n, rows = [], i, 0, 0
            n, rows = n + len(t), rows + 1
        if lo < len(f):
            held.append(f.slice(lo))
    if rows:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _digest(parts: pa.LargeStringArray) -> int:
    """Names the strings of an array in their order (63 bits)."""
    raw = parts.cast(pa.large_binary())
    h = xxhash.xxh3_64(pc.binary_length(raw).to_numpy().tobytes())
    h.update(b"".join(raw.to_pylist()))
    return h.intdigest() >> 1


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs. model: a sentencepiece file, by default MODEL."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    arrow_kind, name = to_arrow_type(kind), kind.simpleString()
    bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SLOT + 1)

    def counter() -> PieceCounter:
        import public_tokenizers

        return PieceCounter(model or public_tokenizers.path(MODEL))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch, Block]]:
        c, task = counter(), TaskContext.get().partitionId()
        for i, f in enumerate(_blocks(batches)):
            yield f"{task} {i}", f, c.block(f.column("text").to_pylist(), slots)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, b in blocks(batches):
            each, at = np.unique(b.slot, return_index=True)
            ends = [*at[1:].tolist(), len(b.slot)]
            slices = [b.parts.slice(lo, hi - lo) for lo, hi in zip(at.tolist(), ends, strict=True)]
            packed = list(map(_packed_strings, slices))
            yield pa.RecordBatch.from_pydict({"slot": pa.array(each), "block": [key] * len(each), "digest": pa.array(map(_digest, slices), pa.int64()), "lengths": pa.array([x for x, _ in packed], pa.binary()), "parts": pa.array([x for _, x in packed], pa.binary())})

    def counted(t: pa.Table) -> pa.Table:
        lengths = [_unpacked(x) for x in t.column("lengths").to_pylist()]
        code = _unpacked_strings(np.concatenate(lengths), t.column("parts").to_pylist()).dictionary_encode()
        n = np.array(counter().counts(code.dictionary.to_pylist()), np.int64)[code.indices.to_numpy()]
        back = np.split(n, np.cumsum([len(x) for x in lengths])[:-1])
        return pa.table({"block": t.column("block"), "slot": t.column("slot"), "digest": t.column("digest"), "n": pa.array(map(_packed, back), pa.binary())})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, f, b in blocks(batches):
            ends = pa.array([0, f.num_rows], pa.int32())
            ids, sizes = pa.ListArray.from_arrays(ends, f.column("doc_id").cast(arrow_kind)), pa.ListArray.from_arrays(ends, f.column("n_bytes"))
            _, at = np.unique(b.slot, return_index=True)
            digests = [_digest(b.parts.slice(lo, hi - lo)) for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(b.slot)], strict=True)]
            packed = [_packed(b.base), _packed(b.per_part), _packed(b.doc, np.uint16), _packed(b.times), _packed(np.array(digests, np.int64), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([key]), ids, sizes, *[pa.array([x], pa.binary()) for x in packed]], ["block", "ids", "sizes", "base", "per_part", "doc", "times", "digests"])

    def summed(own: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("slot")
        n = np.concatenate([np.empty(0, np.uint32), *[_unpacked(x) for x in counts.column("n").to_pylist()]]).astype(np.int64)
        base, per_part, doc, times = (_unpacked(own.column(k)[0].as_py(), t) for k, t in (("base", np.uint32), ("per_part", np.uint32), ("doc", np.uint16), ("times", np.uint32)))
        # the two scans have to have found the same pre-tokens in the same order, slot by slot
        if len(n) != len(per_part) or counts.column("digest").to_pylist() != _unpacked(own.column("digests")[0].as_py(), np.int64).tolist():
            raise ValueError("the rows of docs came in another order in the second scan")
        total = Block(base.astype(np.int64), np.empty(0), pa.array([], pa.large_string()), per_part, doc, times.astype(np.int64)).total(n)
        ids, sizes = (pc.list_flatten(own.column(k)) for k in ("ids", "sizes"))
        return pa.table({"doc_id": ids, "n_bytes": sizes, "n_tokens": pa.array(total), "over_limit": pa.array(total > limit)})

    counts = rows.mapInArrow(distinct, "slot long, block string, digest long, lengths binary, parts binary").groupBy("slot").applyInArrow(counted, "block string, slot long, digest long, n binary")
    found = rows.mapInArrow(frequencies, f"block string, ids array<{name}>, sizes array<long>, base binary, per_part binary, doc binary, times binary, digests binary")
    joined = found.groupBy("block").cogroup(counts.groupBy("block"))
    return joined.applyInArrow(summed, f"doc_id {name}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE_SQL: dict[str, str] = {}  # compared with the library on whole texts in tests/llm
