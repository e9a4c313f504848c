"""Near-dedup against all pairs of shingle sets."""

import random

import numpy as np
import pytest

from corpusloom.llm.common import WordHashes
from corpusloom.llm.nearest import K, components, dart_signatures, linked_in_cell, near_duplicates, shingles, similarity

from .fixtures import documents, frame, odd, with_clashes, words


def sets(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, least=0.8):
    """Class of each row by number, from all pairs."""
    s = [sets(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if (both and both / len(s[i] | s[j]) >= least) or (rows[i][0] == rows[j][0] and s[i] == s[j]):
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def planted(n=60, seed=4):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        w = [f"g{g}w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 4)):
            v = list(w)
            for _ in range(rng.choice((0, 1, 2, 3))):
                v[rng.randrange(len(v))] = f"e{rng.randrange(10**6)}"
            rows.append((10_000 + len(rows), " ".join(v), "en", "s", 1))
    return rows


def test_against_all_pairs(spark):
    rows = documents() + planted() + [r for r in odd() if r[0] is not None]
    of = {}
    for i, c in enumerate(brute(rows)):
        of.setdefault(c, set()).add(rows[i][0])
    want = {}
    for ids in of.values():
        for d in ids:
            want[d] = min(ids)
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_chain_in_hot_bucket(spark):
    # neighbours are similar, the ends are not: links that a single leader would not see
    base = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(base[2 * i :] + [f"t{i}_{j}" for j in range(2 * i)]), "en", "s", 1) for i in range(30)]
    rows += [(1000 + i, "the same words in all of these documents " * 3, "en", "s", 1) for i in range(300)]
    want = brute(rows)
    first = {}
    for i, c in enumerate(want):
        first.setdefault(c, rows[i][0])
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, rows, parts=8)).collect()}
    assert got == {rows[i][0]: first[c] for i, c in enumerate(want)}


def test_repeated_ids_nulls_clashes_and_empty(spark):
    rows = odd()
    out = near_duplicates(with_clashes(frame(spark, rows), "key set sig class bucket class_id n_shingles packed rep a b")).collect()
    assert len(out) == len(rows)
    assert {r.class_id for r in out if r.doc_id == 900_050} == {900_005}
    assert near_duplicates(frame(spark, [], parts=1)).count() == 0


@pytest.mark.parametrize("two", [False, True])
def test_cell_joins_the_classes_that_all_its_pairs_join(two):
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.integers(0, 2**60, 60).astype(np.uint64)
        sets = []
        for _ in range(14):
            x = base.copy()
            x[rng.choice(60, rng.integers(0, 9), replace=False)] = rng.integers(0, 2**60, 1).astype(np.uint64)
            sets.append(np.unique(x))
        classes, blocks = rng.integers(0, 8, 14), rng.integers(0, 2, 14) if two else np.zeros(14, int)

        def joined(pairs, classes=classes):
            now = classes.tolist()
            for x, y in pairs:
                now = [now[x] if c == now[y] else c for c in now]
            return [[a == b for b in now] for a in now]

        every = [(x, y) for x in range(14) for y in range(x) if similarity((sets[x], None), (sets[y], None)) >= 0.8 and (not two or len(set(blocks)) == 1 or blocks[x] != blocks[y])]
        links = linked_in_cell(list(range(14)), classes, blocks, sets, 0.8)
        assert joined(links) == joined(every) and set(map(frozenset, links)) <= set(map(frozenset, every))


@pytest.mark.parametrize("blocks", [(200, 400), (64_000, 2_000_000)])
def test_group_of_near_copies_with_outliers(spark, monkeypatch, blocks):
    import corpusloom.llm.nearest as m

    monkeypatch.setattr(m, "LEAST_BLOCK", blocks[0])
    monkeypatch.setattr(m, "MOST_BLOCK", blocks[1])
    rng = random.Random(3)
    base = [f"n{i}" for i in range(140)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(140)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    got, first = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, rows)).collect()}, {}
    want = brute(rows)
    for i, c in enumerate(want):
        first.setdefault(c, i)
    assert got == {i: first[c] for i, c in enumerate(want)}


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_agree_as_often_as_sets_are_similar(weighted):
    rng = np.random.default_rng(2)
    agree, want = [], []
    for _ in range(150):
        both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 60, 40))
        a, b = np.concatenate([both, one]), np.concatenate([both, two])
        wa, wb = (rng.integers(1, 4, len(x)) for x in (a, b)) if weighted else (np.ones(len(a)), np.ones(len(b)))
        if weighted:
            least, most = np.minimum(wa[:300], wb[:300]).sum(), np.maximum(wa[:300], wb[:300]).sum() + wa[300:].sum() + wb[300:].sum()
        else:
            least, most = 300, 400
        s = dart_signatures([a, b], [wa, wb] if weighted else None)
        agree.append((s[0] == s[1]).mean())
        want.append(least / most)
    assert abs(np.mean(agree) - np.mean(want)) < 4 * 0.5 / (150 * K) ** 0.5


def test_signatures_of_small_sets_are_full_and_the_same_each_time():
    h, _ = shingles(b"a b c d e f g".split(), WordHashes())
    one = dart_signatures([h, h[:1]])
    two = dart_signatures([h[:1], h])
    assert (one[0] == two[1]).all() and (one[1] == two[0]).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (3, 10), (10, 11), (20, 21), (21, 22), (22, 20)]
    got = {r["key"]: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20}


def test_texts_under_one_id_or_none_keep_their_links(spark):
    rng = random.Random(8)
    text = [[f"t{k}w{rng.randrange(10**6)}" for _ in range(80 + 10 * k)] for k in range(8)]
    near = lambda k: " ".join([*text[k][:-1], f"other{rng.randrange(10**6)}"])
    rows = [(k, near(k)) for k in range(8)]
    rows += [(None, near(k)) for k in (0, 1, 2)]  # other texts without doc_id
    rows += [(50, near(k)) for k in (3, 4, 5)] + [(50, near(3))] + [(60, " ".join(text[6]))] * 3
    rows += [(None, "alone without an id " + " ".join(f"x{i}" for i in range(30))), (7, "under the id of another text " + " ".join(f"y{i}" for i in range(40)))]
    got = sorted((r.doc_id, r.class_id, r.n_shingles) for r in near_duplicates(frame(spark, rows, "doc_id long, text string")).collect() if r.doc_id is not None)
    n = lambda t: len(sets(t))
    classes = {4: 3, 5: 3, 50: 3, 60: 6}
    assert got == sorted((d, classes.get(d, d), n(t)) for d, t in rows if d is not None)
    got = {(r.class_id, r.n_shingles) for r in near_duplicates(frame(spark, rows, "doc_id long, text string")).where("doc_id IS NULL").collect()}
    assert got == {(k, n(near(k))) for k in (0, 1, 2)} | {(None, n(rows[-2][1]))}


def test_a_batch_is_signed_together():
    """Short documents need many ranks, which a whole batch goes through once; the signatures are the same however it is cut."""
    from corpusloom.llm import common, nearest

    assert nearest.TOGETHER >= common.MOST_ROWS
    sets = [np.unique(np.random.default_rng(i).integers(0, 2**63, 1 + i % 40).astype(np.uint64)) for i in range(60)]
    assert (dart_signatures(sets) == np.concatenate([dart_signatures(sets[:7]), dart_signatures(sets[7:])])).all()
