"""Substring dedup against a dictionary of all windows."""

import hashlib

import numpy as np

from corpusloom.llm.repeats import parse, remove_repeats

from .fixtures import documents, frame, odd, with_clashes, words

N = 13


def brute(rows):
    key = lambda d: 2**63 if d is None else d
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - N + 1):
            g = tuple(w[i : i + N])
            first[g] = min(first.get(g, 2**63), key(d))
    out = []
    for d, t, *_ in rows:
        w, gone = words(t), set()
        for i in range(len(w) - N + 1):
            if first[tuple(w[i : i + N])] < key(d):
                gone.update(range(i, i + N))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def run(df):
    return [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in remove_repeats(df).collect()]


def test_against_all_windows(spark):
    base = documents()
    w = " ".join(f"q{i}" for i in range(40))
    # a run whose source changes from word to word, a repeat inside one document, copies in order and against it
    more = [(700, w, "en", "s", 1), (701, " ".join(w.split()[:20]) + " zz", "en", "s", 1), (702, "yy " + " ".join(w.split()[10:]), "en", "s", 1), (703, f"{w} {w} end", "en", "s", 1), (699, " ".join(w.split()[5:30]), "en", "s", 1)]
    rows = base + more + odd()
    assert sorted(run(frame(spark, rows)), key=str) == sorted(brute(rows), key=str)


def test_hot_passage_and_clashing_columns(spark):
    hot = " ".join(f"h{i}" for i in range(20))
    rows = [(i, f"a{i} b{i} {hot} c{i}", "en", "s", 1) for i in range(400)]
    df = with_clashes(frame(spark, rows, parts=16), "key bucket block hashes docs packed kept factors")
    assert sorted(run(df)) == sorted(brute(rows))


def test_empty(spark):
    assert run(frame(spark, [], parts=1)) == []


def test_parse_follows_the_places_of_the_source():
    last = 2**63 - 1
    source, place = np.array([last, 3, 3, 3, 5, 5, last]), np.array([0, 7, 8, 2, 3, 4, 0])
    assert parse(source, place) == [(1, 14, 3, 7), (3, 13, 3, 2), (4, 14, 5, 3)]


def test_factors_stand_in_their_sources(spark):
    w = [f"w{i}" for i in range(1, 41)]
    jump = " ".join(w[:13] + [f"x{i}" for i in range(20)] + w[1:14])
    rows = documents() + [(6000, jump, "en", "s", 1), (6001, " ".join(w[:14]), "en", "s", 1), (6002, " ".join(["a", *w[:14], "b", *w[1:14]]), "en", "s", 1)]
    texts = {d: words(t) for d, t, *_ in rows}
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - N + 1):
            first.setdefault(tuple(texts[d][i : i + N]), (d, i))
    got = {r.doc_id: r.factors for r in remove_repeats(frame(spark, rows)).collect()}
    assert [tuple(f) for f in got[6001]] == [(0, 13, 6000, 0), (1, 13, 6000, 33)]
    assert sum(map(len, got.values())) > 10
    for d, factors in got.items():
        for a, n, s, p in map(tuple, factors):
            assert s < d and n >= N and texts[d][a : a + n] == texts[s][p : p + n]
            # the next window is not the next one of the source, or the source is not the earliest that has it
            after = tuple(texts[d][a + n - N + 1 : a + n + 1])
            assert len(after) < N or first[after] != (s, p + n - N + 1)
