"""Shards: near equal in bytes, gapless slots, copies together."""

import zlib
from collections import Counter, defaultdict

from corpusloom.llm.ranges import sampled_splitters, with_offsets
from corpusloom.llm.sharding import shard_records

from .fixtures import documents, frame, odd, with_clashes


def test_all_laws(spark):
    rows = documents() + odd()[:7] + odd()[8:]
    got = shard_records(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    slots, total = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        total[r.shard] += r["size"]
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) <= 2 * max(size(t) for _, t, *_ in rows)


def test_small_groups_of_copies_stay_together(spark):
    rows = [(i, f"text {i // 3} " + "x" * 50, "en", "s", 1) for i in range(6000)]
    at = defaultdict(set)
    for r in shard_records(frame(spark, rows)).select("text_crc32", "shard").collect():
        at[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in at.values())


def test_hot_group_is_divided(spark):
    rows = [(i, "same text for all" if i % 3 == 0 else f"own {i}", "en", "s", 1) for i in range(6000)]
    total = Counter()
    for r in shard_records(with_clashes(frame(spark, rows, parts=8), "size shard slot _h _id law _cell")).collect():
        total[r.shard] += r["size"]
    assert max(total.values()) - min(total.values()) < 0.01 * sum(total.values())


def test_empty(spark):
    assert shard_records(frame(spark, [], parts=1)).count() == 0


def test_offsets_are_exact_prefix_sums(spark):
    rows = [((i * 7919) % 1000, i, 1 + i % 17) for i in range(5000)]
    df = spark.createDataFrame(rows, "a long, b long, w long")
    got = with_offsets(df, ("a", "b"), "w", sampled_splitters(df, ("a", "b"), "w", 20)).collect()
    upto = 0
    for i, (r, want) in enumerate(zip(sorted(got, key=lambda r: (r.a, r.b)), sorted(rows), strict=True)):
        assert (r._rank, r._offset) == (i, upto)
        upto += want[2]


def test_ranges_are_those_of_a_binary_search(spark):
    import random
    from bisect import bisect_right

    from corpusloom.llm.ranges import with_cells

    rng, top = random.Random(3), 2**63 - 1
    for keys in ([(rng.randint(-top, top), rng.randint(0, 3)) for _ in range(90)], [(rng.randint(0, 4), rng.randint(-9, 9)) for _ in range(60)], [(7, -top - 1)], [(-top - 1, 0), (top, top)], []):
        splitters = sorted(set(keys))
        rows = keys + [(a + x, b + y) for a, b in keys for x in (0, 1) for y in (-1, 0, 1) if -top <= a + x <= top and -top <= b + y <= top] + [(rng.randint(-top, top), 0) for _ in range(50)]
        got = with_cells(spark.createDataFrame(rows, "a long, b long"), splitters, ("a", "b")).collect()
        assert len(got) == len(rows) and all(r._cell == bisect_right(splitters, (r.a, r.b)) for r in got)
