"""The pipeline's stages against plain Python, on the smallest test table and on odd rows."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline

from .fixtures import SF, benchmark, documents, frame, odd, with_clashes
from .test_near import brute

CLASHES = "key row size copies taken target source_size score lang_pred held_out _cell _h _id _t _place _rank _offset _source _first _u _per class_id first"


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def has_words(t):
    return any(c.isalpha() for c in t or "")


def leaks(text, items):
    flat = f" {' '.join((text or '').split())} "
    return any(f" {' '.join(t.split())} " in flat for _, t in items)


@pytest.fixture(scope="module")
def run_once(spark):
    """Each stage's input and output, as rows."""
    docs, out = frame(spark, documents() + odd()), []
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = pipeline.stored(stage(spark, docs, SF))
        out.append((name, rows_of(before), rows_of(docs)))
    return out, docs


def test_language_stage_drops_what_has_no_letters(run_once):
    _, before, after = run_once[0][0]
    assert Counter(after) == Counter(r for r in before if has_words(r[1]))


def test_near_dedup_stage_keeps_one_of_each_class(run_once):
    _, before, after = run_once[0][1]
    # rows are judged one by one, so the brute force gets an id for each
    of = brute([(i, r[1]) for i, r in enumerate(before)])
    groups = {}
    for c, r in zip(of, before, strict=True):
        groups.setdefault(c, []).append(r)
    assert len(after) == len(groups)
    least = lambda rows: min((r[0] is None, r[0] or 0) for r in rows)
    assert Counter((r[0] is None, r[0] or 0) for r in after) == Counter(least(g) for g in groups.values())
    assert not Counter(after) - Counter(before)


def test_decontamination_stage_drops_verbatim_items_and_little_else(run_once):
    _, before, after = run_once[0][2]
    items = benchmark()
    assert not [r for r in after if leaks(r[1], items)]
    gone = Counter(before) - Counter(after)
    assert not Counter(after) - Counter(before) and any(leaks(r[1], items) for r in gone)


def test_mixing_stage_takes_each_source_near_its_target(run_once):
    _, before, after = run_once[0][3]
    size = lambda t: len((t or "").encode().split())
    total, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        total[r[3]] += size(r[1])
        largest[r[3]] = max(largest[r[3]], size(r[1]))
    for r in after:
        taken[r[3]] += size(r[1])
    assert all(c <= 2 * n for r, c in Counter(after).items() for n in [Counter(before)[r]])
    assert all(taken[s] <= 2 * total[s] for s in total)
    # targets by the stated rule
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        for s in full or open_:
            want[s] = 2 * total[s] if full else level * weight[s]
            left -= want[s]
        open_ -= full or open_
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in names)


def test_sharding_stage_places_every_row(spark, run_once):
    docs = run_once[1]
    got = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows_of(docs))
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_clashing_columns_come_through(spark):
    docs = with_clashes(frame(spark, documents()[:40] + odd()), CLASHES)
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, SF))
        assert docs.columns[5:] == CLASHES.split()
        assert {tuple(r) for r in docs.select(*CLASHES.split()).collect()} == {("clash",) * len(CLASHES.split())}
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0


def test_rows_without_ids_are_judged_by_their_texts(spark):
    item = max((t for _, t in benchmark() if t), key=len)
    text = " ".join(f"own{i} words{i % 7}" for i in range(90))
    near = frame(spark, [(None, text, "en", "s", 1), (None, text + " end", "en", "s", 1), (5, text, "en", "s", 1), (7, "other " * 3 + item, "en", "s", 1), (7, text + " tail", "en", "s", 1)])
    assert sorted(r[0] for r in rows_of(pipeline.near_dedup_stage(spark, near, SF))) == [5, 7]
    leaky = frame(spark, [(None, item, "en", "s", 1), (None, text, "en", "s", 1), (3, text, "en", "s", 1), (3, f"before it {item} and after it", "en", "s", 1)])
    assert sorted(r[1] for r in rows_of(pipeline.decontamination_stage(spark, leaky, SF))) == [text, text]


def test_empty_table(spark):
    docs = frame(spark, [], parts=1)
    for _, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, SF))
    assert docs.count() == 0
