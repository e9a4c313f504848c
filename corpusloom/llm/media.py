"""Media columns: ISO base media files, written, walked and read back without decoding payloads.

`wrap` stores 8-bit samples as one track of an ISO file (ftyp, mdat, moov). `walk` yields the nested boxes of any such
file; `sample_ranges` decodes the sample tables (stsz, stsc, stco/co64, stts, stss) into byte ranges; `features` gives
codec, duration and key-frame byte ranges. Only box headers and tables are looked at; mdat is never interpreted.

Nulls, ties and odd input: a null text counts as empty; the payload is then one frame of 255s. Equal texts give equal
bytes (no clock or random number goes in). Repeated rows each get a row; an empty table gives no rows; only doc_id and
text are read, so other columns cannot clash. Files over 4 GB get 64-bit boxes and offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Bytes of a frame (one sample of the track), frames of a chunk, and every so many frames a key frame.
FRAME, CHUNK, KEY_EVERY = 576, 16, 8
RATE = 48_000
#: Boxes that hold boxes, and the bytes of their own fields before the first.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"stsd": 8, b"dref": 8, b"meta": 4}
_UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body) + 8
    return struct.pack(">I4s", n, kind) + body if n < 2**32 else struct.pack(">I4sQ", 1, kind, n + 8) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes, unit: int = FRAME) -> bytes:
    n = max(unit, -(-len(data) // unit) * unit)
    return data + b"\xff" * (n - len(data))


def wrap(payload: bytes, frame: int = FRAME) -> bytes:
    """An ISO file of one sound track: 8-bit unsigned samples ('raw '), ``frame`` bytes to a table entry."""
    n = len(payload) // frame
    chunks = -(-n // CHUNK)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomqt  ")
    mdat = _box(b"mdat", payload)
    first = len(ftyp) + len(mdat) - len(payload)
    offsets = first + np.arange(chunks, dtype=np.uint64) * CHUNK * frame
    wide = bool(chunks) and int(offsets[-1]) >= 2**32
    runs = [(1, CHUNK if n >= CHUNK else n)] + ([(chunks, n - (chunks - 1) * CHUNK)] if chunks > 1 and n % CHUNK else [])
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, frame)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", c, k, 1) for c, k in runs)),
        _full(b"stsz", struct.pack(">II", frame, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    ticks = n * frame
    head = struct.pack(">QQIQ", 0, 0, RATE, ticks)
    minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", head, struct.pack(">HH", 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), _UNITY, bytes(8), version=1, flags=7)
    mvhd = _full(b"mvhd", head, struct.pack(">IH", 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2), version=1)
    return ftyp + mdat + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box types, start of the body, end) of every box, outer boxes first. A box that runs past its parent ends
    the walk of that parent, so cut or broken files give what can be read."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if n == 1 and body + 8 <= end:
            n, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif n == 0:
            n = end - start
        if n < body - start or start + n > end:
            return
        here = (*path, kind)
        yield here, body, start + n
        if kind in CONTAINERS:
            yield from walk(data, body + CONTAINERS[kind], start + n, here)
        start += n


def tracks(data: bytes) -> list[dict[bytes, bytes]]:
    """The table boxes of each track, by type."""
    out: list[dict[bytes, bytes]] = []
    for path, a, b in walk(data):
        if path == (b"moov", b"trak"):
            out.append({})
        elif path[:2] == (b"moov", b"trak") and path[-1] not in CONTAINERS:
            if path[-2] == b"stsd":
                out[-1].setdefault(b"codec", path[-1])
            else:
                out[-1].setdefault(path[-1], data[a:b])
    return out


def sample_ranges(t: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of each sample of a track, from its tables."""
    fixed, n = struct.unpack_from(">II", t[b"stsz"], 4)
    size = np.full(n, fixed, np.int64) if fixed else np.frombuffer(t[b"stsz"], ">u4", n, 12).astype(np.int64)
    wide = b"co64" in t
    table_ = t[b"co64" if wide else b"stco"]
    chunks = struct.unpack_from(">I", table_, 4)[0]
    at = np.frombuffer(table_, ">u8" if wide else ">u4", chunks, 8).astype(np.int64)
    runs = np.frombuffer(t[b"stsc"], ">u4", 3 * struct.unpack_from(">I", t[b"stsc"], 4)[0], 8).reshape(-1, 3).astype(np.int64)
    per = np.repeat(runs[:, 1], np.diff([*runs[:, 0], chunks + 1])) if len(runs) else np.empty(0, np.int64)
    chunk = np.repeat(np.arange(len(per)), per)[:n]
    upto = np.cumsum(size) - size
    first = np.concatenate([[0], np.cumsum(per)[:-1]]) if len(per) else np.empty(0, np.int64)
    return at[chunk] + upto - upto[np.minimum(first, max(n - 1, 0))][chunk], size


def features(data: bytes) -> str:
    """codec, duration in seconds, samples and key-frame byte ranges of the first track, from headers and tables alone."""
    found = tracks(data)
    if not found:
        return ""
    t = found[0]
    rate, ticks = struct.unpack_from(">IQ", t[b"mdhd"], 20) if t[b"mdhd"][0] else struct.unpack_from(">II", t[b"mdhd"], 12)
    at, size = sample_ranges(t)
    keys = np.frombuffer(t[b"stss"], ">u4", struct.unpack_from(">I", t[b"stss"], 4)[0], 8).astype(np.int64) - 1 if b"stss" in t else np.arange(len(at))
    ranges = ",".join(f"{a}-{b}" for a, b in zip(at[keys].tolist(), (at[keys] + size[keys]).tolist(), strict=True))
    return f"codec={t[b'codec'].decode('latin-1').strip()};duration={ticks / rate:.6f};samples={len(at)};keyframes={ranges}"


def read_payload(data: bytes) -> bytes:
    """The bytes of the first track, sample by sample."""
    at, size = sample_ranges(tracks(data)[0])
    if not len(at):
        return b""
    cut = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1  # neighbours are read in one piece
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    return b"".join(data[a:b] for a, b in zip(at[lo].tolist(), (at[hi] + size[hi]).tolist(), strict=True))


def media_columns(docs: DataFrame, *, with_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; media on request."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media

    def row(text: str) -> tuple:
        raw = text.encode("utf-8")
        media = wrap(padded(raw))
        back = read_payload(media)
        out = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(media))
        return (*out, media) if with_media else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for whole in batches:
            for lo in range(0, len(whole), 500):
                part = whole.slice(lo, 500)
                cols = list(zip(*map(row, part.column("text").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, cols)], names)

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


QUERIES = {"op5_media_columns": op5_media_columns}
ORACLE_SQL: dict[str, str] = {}  # exact round trip in tests/llm
