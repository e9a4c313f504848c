"""ISO files: exact round trip, and boxes read by an independent reader."""

import hashlib
import struct
import zlib

from corpusloom.llm.media import features, media_columns, padded, read_payload, sample_ranges, tracks, walk, wrap

from .fixtures import documents, frame, odd, with_clashes


def test_columns(spark):
    rows = documents() + odd()
    got = media_columns(with_clashes(frame(spark, rows), "media feature n_bytes")).collect()
    assert len(got) == len(rows)
    of = {}
    for _, t, *_ in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        of[hashlib.sha256(p).hexdigest()] = (len(raw), len(p), zlib.crc32(p[-32:]))
    for r in got:
        assert of[r.payload_sha256] == (r.n_bytes, r.payload_bytes, r.tail_crc32)
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_file_is_an_iso_file():
    p = padded(bytes(range(256)) * 40)
    media = wrap(p)
    at, kinds = 0, []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        kinds.append(kind)
        at += n
    assert at == len(media) and kinds == [b"ftyp", b"mdat", b"moov"]
    paths = [x[0] for x in walk(media)]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in paths
    assert read_payload(media) == p
    at, size = sample_ranges(tracks(media)[0])
    assert b"".join(media[a : a + n] for a, n in zip(at.tolist(), size.tolist(), strict=True)) == p
    f = dict(x.split("=") for x in features(media).split(";"))
    assert f["codec"] == "raw" and float(f["duration"]) == round(len(p) / 48000, 6) and int(f["samples"]) == len(p) // 576
    assert f["keyframes"].split(",")[1] == f"{int(at[8])}-{int(at[8]) + 576}"


def test_broken_and_foreign_files():
    media = wrap(padded(b"x" * 5000))
    for cut in (0, 3, 20, 100, len(media) - 1):
        list(walk(media[:cut]))
        assert features(media[:cut]) == ""
    # samples of different sizes, two chunks, 64-bit box size
    full = lambda k, *b: struct.pack(">I4sI", 12 + sum(map(len, b)), k, 0) + b"".join(b)
    box = lambda k, *b: struct.pack(">I4s", 8 + sum(map(len, b)), k) + b"".join(b)
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + 10) + b"aabbbcdddd"
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stsz", struct.pack(">II4I", 0, 4, 2, 3, 1, 4)), full(b"stsc", struct.pack(">I6I", 2, 1, 3, 1, 2, 1, 1)), full(b"stco", struct.pack(">I2I", 2, 16, 22)))
    mdhd = full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 2500))
    t = head + box(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl))))
    assert read_payload(t) == b"aabbbcdddd"
    assert features(t) == "codec=avc1;duration=2.500000;samples=4;keyframes=16-18,18-21,21-22,22-26"


def test_empty(spark):
    assert media_columns(frame(spark, [], parts=1)).count() == 0
