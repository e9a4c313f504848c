"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from corpusloom.llm.resampling import features, op12_resampling, resample

from .fixtures import SF, benchmark, documents, frame, odd, with_clashes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def plain_features(text, words=1, buckets=10_000):
    w = WORD.findall(re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (text or "").encode()))
    runs = [b" ".join(w[i : i + n]) for n in range(1, words + 1) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r) % buckets for r in runs]


def brute(docs, items, words=1, buckets=10_000, least=20, percent=10, seed=2024):
    each = [(d, *plain_features(t, words, buckets)) for d, t in docs]
    s, t = Counter(b for *_, f in each for b in f), Counter(b for _, x in items for b in plain_features(x, words, buckets)[1])
    a, b = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in s}
    rows = []
    for d, n, f in each:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = i
    return sorted(map(tuple, rows), key=str)


def test_query_is_the_plain_one(spark):
    want = [(r[0], *r[2:]) for r in brute([r[:2] for r in documents()], benchmark())]
    got = sorted(map(tuple, op12_resampling(spark, SF).collect()), key=str)
    assert got == sorted(want, key=str) and sum(r[4] is not None for r in got) > 10


@pytest.mark.parametrize("words", [1, 2, 3])
def test_odd_rows_and_runs_of_words(spark, words):
    rows = documents()[:120] + odd()
    got = resample(with_clashes(frame(spark, rows), "weight score rank n_words _id _place bucket"), frame(spark, benchmark()[:9], ITEMS), words=words, buckets=700, percent=35, ranges=5)
    assert sorted(map(tuple, got.collect()), key=str) == brute([r[:2] for r in rows], benchmark()[:9], words, 700, percent=35)


def test_features_of_sliced_and_odd_texts():
    texts = ["", "AbC dé", "x" * 1000 + " y", "a", "b", "\x00a\x7fb{C}", "日本 z", " ", "Z" * 64 + "0" + "k" * 65, "", "end"]
    for lo in range(len(texts)):
        part = pa.array(texts).slice(lo)
        for words in (1, 2, 3, 4):
            n, doc, bucket = features(part, words, 2**31)
            for i, t in enumerate(texts[lo:]):
                count, want = plain_features(t, words, 2**31)
                assert (n[i], bucket[doc == i].tolist()) == (count, want)


def test_ties_go_to_the_smaller_id_and_repeated_rows_stand_side_by_side(spark):
    rows = [(i // 2, "same words " * 12, "en", "s", 1) for i in range(60)] + [(None, "same words " * 12, "en", "s", 1)]
    got = resample(frame(spark, rows), frame(spark, [(1, "other")], ITEMS), percent=100).collect()
    assert sorted(map(tuple, got), key=str) == brute([r[:2] for r in rows], [(1, "other")], percent=100)
    assert sorted(r["rank"] for r in got) == list(range(1, 62))


def test_empty_tables(spark):
    none, items = frame(spark, [], parts=1), frame(spark, [], ITEMS, parts=1)
    assert resample(none, items).count() == 0
    assert resample(none, frame(spark, benchmark(), ITEMS)).count() == 0
    got = resample(frame(spark, documents()[:30]), items).collect()
    assert sorted(map(tuple, got), key=str) == brute([r[:2] for r in documents()[:30]], [])
