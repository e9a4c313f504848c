"""Embedding near-dedup against all pairs."""

import math

import numpy as np
import pytest

from corpusloom.llm.embeddings import _Window, embedding_duplicates, hash_keys, joining, links_within, op13_embedding_duplicates, passes_for, unit
from corpusloom.llm.common import table

from .fixtures import SF, frame, with_clashes

ROWS = "vec_id long, embedding array<float>, label int"


def noisy(rng, base, angle):
    """A vector at the given angle to base."""
    b = base / np.linalg.norm(base)
    e = rng.standard_normal(len(b))
    e -= (e @ b) * b
    return math.cos(angle) * b + math.sin(angle) * e / np.linalg.norm(e)


def clusters(seed=0, d=24, labels=2, singles=150):
    """Lone vectors, pairs near the threshold, groups of near copies, chains and copies."""
    rng, out = np.random.default_rng(seed), []
    for label in range(labels):
        out += [(rng.standard_normal(d), label) for _ in range(singles)]
        for cos in (0.925, 0.929, 0.931, 0.94, 0.96, 0.99):
            for _ in range(4):
                base = rng.standard_normal(d)
                out += [(base, label), (3 * noisy(rng, base, math.acos(cos)), label)]
        for size, angle in ((40, 0.1), (30, 0.22), (25, 0.3)):
            base = rng.standard_normal(d)
            out += [(noisy(rng, base, angle), label) for _ in range(size)]
        x, y = rng.standard_normal((2, d))
        y -= (x @ y) / (x @ x) * x
        x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
        out += [(math.cos(t) * x + math.sin(t) * y, label) for t in np.arange(12) * 0.35]  # a chain
        out += [(out[-1][0], label)] * 20
    order = rng.permutation(len(out))
    return [(i * 3, [float(np.float32(v)) for v in out[j][0]], out[j][1]) for i, j in enumerate(order.tolist())]


def usable(v, label):
    return v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, least=0.93):
    n = len(rows)
    x = [np.array(v, float) if usable(v, g) else None for _, v, g in rows]
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                a, b = unit(x[i][None]), unit(x[j][None])
                if (a @ b.T)[0, 0] >= least:
                    near[i].append(j)
                    near[j].append(i)
    last = 2**63 - 1
    ident = [last if r[0] is None else r[0] for r in rows]
    least_of, seen = [0] * n, set()
    for i in range(n):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            for j in group:
                least_of[j] = min(ident[k] for k in group)
    return sorted(((rows[i][0], len(near[i]), None if least_of[i] == last else least_of[i], ident[i] == least_of[i]) for i in range(n)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_is_the_plain_one(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").collect()]
    assert got(op13_embedding_duplicates(spark, SF)) == brute(rows)


@pytest.mark.parametrize(("window", "cell", "parts"), [(512, 4096, None), (16, 10, 7)])
def test_clusters(spark, window, cell, parts):
    """With narrow windows, many ends of partitions and small cells as with one window; some pairs at the threshold are told
    apart."""
    rows = clusters()
    found = got(embedding_duplicates(frame(spark, rows, ROWS), window=window, cell=cell, parts=parts, miss=1e-4))
    assert found == brute(rows)
    assert max(r[1] for r in found) >= 39


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 0.5]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [inf, 1.0], 0), (7, v, None), (8, v, None), (None, v, 3), (None, v, 3)]
    rows += [(9, v, 0), (10, v, 0), (10, v, 0), (10, v, 0), (11, [2.0, 4.0, 1.0], 0), (12, [-1.0, -2.0, -0.5], 0), (13, v[:2], 0), (14, [1e38, 2e38, 0.5e38], 0), (15, [1e-30, 2e-30, 0.5e-30], 0)]
    rows += [(16, v, 1), (None, v, 1), (17, [1.0], 0), (18, [5.0], 0), (19, [-0.0, 1.0], 0), (20, [0.0, 1.0], 0)]
    docs = with_clashes(frame(spark, rows, ROWS), "key class n copies grp size vec n_links component_id kept id h1")
    assert got(embedding_duplicates(docs)) == brute(rows)


def test_vector_that_a_third_of_all_rows_share(spark):
    rows = [(i, [1.0, 0.5, 0.25], 1) for i in range(3000)] + [(3000 + i, v, g) for i, (_, v, g) in enumerate(clusters(3, d=3, labels=1, singles=20))]
    found = {r[0]: r for r in got(embedding_duplicates(frame(spark, rows, ROWS)))}
    one = found[5]
    assert one[1] >= 2999 and one[2] == 0 and not one[3] and found[0][3] and len(found) == len(rows)


def test_doubles_and_other_columns(spark):
    rows = [(1, [1e200, 2e200], 0), (2, [1e-200, 2e-200], 0), (3, [1.0, -2.0], 0)]
    assert got(embedding_duplicates(frame(spark, rows, "vec_id int, embedding array<double>, label string"))) == brute(rows)


def test_empty(spark):
    assert embedding_duplicates(frame(spark, [], ROWS, parts=1)).count() == 0


def test_core_of_a_large_class_is_counted_without_meeting(spark):
    """A tight group with a few members further out: equal to all pairs."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    x = [noisy(rng, base, a) for a in [0.05] * 60 + [0.18] * 20 + [0.2] * 20 + [0.33] * 10]
    rows = [(7, i, 1 + i % 3, np.float64(v).tobytes()) for i, v in enumerate(x)]
    found = dict(map(tuple, links_within(spark.createDataFrame(rows, "class long, key long, copies long, vec binary"), 0.93, np.dtype(np.float64), cell=16).collect()))
    u = unit(np.stack(x))
    yes = (u @ u.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    want = yes @ np.array([r[2] for r in rows])
    assert [found.get(i, 0) for i in range(len(x))] == want.tolist()


def test_passes_find_pairs_at_the_threshold():
    """Pairs at a cosine of just the threshold among many vectors: the share that no pass sorts within a window."""
    rng, n, window = np.random.default_rng(8), 30_000, 64
    base = rng.standard_normal((300, 48))
    pairs = np.stack([noisy(rng, b, math.acos(0.9301)) for b in base])
    x = unit(np.concatenate([base, pairs, rng.standard_normal((n - 600, 48))]))
    turns, hashes = passes_for(n, 0.93, window)
    met = np.zeros(300, bool)
    for turn in range(turns):
        place = np.empty(n, np.int64)
        place[np.lexsort([np.arange(n), hash_keys(x, turn, hashes)])] = np.arange(n)
        met |= np.abs(place[:300] - place[300:600]) <= window
    assert 4 < turns < 40 and met.mean() >= 0.98


def test_joining_links_are_few_and_enough():
    rng = np.random.default_rng(2)
    yes = rng.random((30, 30)) < 0.05
    yes |= yes.T
    np.fill_diagonal(yes, False)
    links = joining(yes, same=True)
    assert len(links) < 30 and all(yes[i, j] for i, j in links)
    full = np.ones((40, 60), bool)
    assert len(joining(full, same=False)) == 99


def test_window_holds_the_rows_before():
    w = _Window(0.9, 8)
    x = unit(np.tile([[1.0, 2.0]], (3, 1)))
    links = [w.links(np.arange(3) + 3 * i, np.zeros(3, np.int64), x) for i in range(5)]
    assert len(w.key) == 8 and {k for pair in links[-1] for k in pair} >= {12, 13, 14}
