"""Language ID: the lattice against all segmentations, and held-out accuracy."""

import itertools
import math
import zlib

import numpy as np
import pytest

from corpusloom.llm.langid import UNKNOWN, Lattice, Model, fit_model, identify, vocabulary

from .fixtures import documents, frame, odd, with_clashes


def segmentations(w, longest=4):
    for cuts in itertools.product((0, 1), repeat=len(w) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(w)]
        parts = [w[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if all(len(p) <= longest for p in parts):
            yield parts


def test_forward_sums_all_segmentations():
    lattice = Lattice(["a", "b", "ab", "ba", "aab", "bab", "abab"])
    p = np.random.default_rng(1).random((len(lattice.pieces) + 1, 2))
    p[0] = 0
    model = Model(lattice, ["x", "y"], p)
    for w in ("a", "abab", "babba", "aabzab", "z", "ababababab"):
        prob = lambda s, j: p[lattice.pieces.index(s) + 1, j] if s in lattice.pieces else UNKNOWN if len(s) == 1 else 0.0
        want = [math.log(sum(math.prod(prob(s, j) for s in parts) for parts in segmentations(w))) for j in range(2)]
        assert model.words([w])[0] == pytest.approx(want)
        assert lattice.log_forward(w, p) == pytest.approx(want)


def test_pieces_of_any_length_and_whole_long_words():
    lattice = Lattice(["abcdefg", "hij", *"abcdefghij"])
    p = np.full((len(lattice.pieces) + 1, 1), 0.01)
    p[0] = 0
    p[lattice.pieces.index("abcdefg") + 1] = 0.5
    one = math.log(0.5 + 0.01**7)
    model = Model(lattice, ["x"], p)
    assert model.words(["abcdefg"])[0, 0] == pytest.approx(one)
    # 28 letters are one piece four times; cut after 32 letters the fifth would fall apart
    assert model.words(["abcdefg" * 4])[0, 0] == pytest.approx(4 * one)
    assert model.words(["abcdefg" * 5, "abcdefg" * 400])[:, 0] == pytest.approx([5 * one, 400 * one])


def test_whole_vocabulary():
    pieces = vocabulary()
    assert len(set(pieces)) > 20_000 and max(map(len, pieces)) > 12


def test_expected_counts_are_posteriors():
    lattice = Lattice(["a", "b", "ab", "ba"])
    p = np.array([[0], [0.3], [0.4], [0.2], [0.1]])
    w, want, total = "abba", np.zeros(5), 0.0
    for parts in segmentations(w):
        if all(s in lattice.pieces for s in parts):
            pr = math.prod(p[lattice.pieces.index(s) + 1, 0] for s in parts)
            total += pr
            for s in parts:
                want[lattice.pieces.index(s) + 1] += pr
    assert lattice.expected(lattice.codes([w]), np.array([1.0]), p) == pytest.approx(want / total)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = documents() + odd()
    df = frame(spark, rows)
    got = {}
    for r in identify(df, fit_model(df)).collect():
        got.setdefault(r.doc_id, []).append(r)
    right = n = 0
    for d, t, lang, *_ in rows:
        r = got[d][0]
        assert r.held_out == (zlib.crc32(str("" if d is None else d).encode()) % 5 == 0)
        letters = any(c.isalpha() for c in t or "")
        if d is not None:  # two rows have no doc_id
            assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        if d is not None and d < 900_000 and r.held_out:
            n += 1
            right += r.lang_pred == lang
    assert n > 20 and right / n >= 0.95
    assert sum(map(len, got.values())) == len(rows)


def test_lang_source_and_id_are_no_inputs(spark):
    df = frame(spark, documents())
    model = fit_model(df)
    from pyspark.sql import functions as F

    other = df.select((F.col("doc_id") + 5000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("?").alias("source"))
    a = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in identify(df, model).collect()}
    b = {r.doc_id - 5000: (r.lang_pred, round(r.score, 9)) for r in identify(other, model).collect()}
    assert a == b


def test_nothing_learned_empty_and_clashing(spark):
    from pyspark.sql import functions as F

    df = frame(spark, documents()[:20])
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(none, fit_model(none)).collect()} == {"und"}
    empty = frame(spark, [], parts=1)
    assert identify(empty, fit_model(empty)).count() == 0
    clash = with_clashes(df, "held_out lang_pred score _text word")
    out = identify(clash, fit_model(clash), keep=clash.columns)
    assert out.count() == 20 and out.where("lang_pred = 'clash'").count() == 0
