"""Mixing: the SQL's rows, targets, bounds and repeatability."""

import duckdb

from corpusloom.llm.mixing import ORACLE_SQL, mix_sources

from .fixtures import documents, frame, odd, table, with_clashes

COLS = ["doc_id", "size", "source_size", "target", "taken", "copies"]


def run(df):
    return [tuple(r) for r in mix_sources(df, keep=["doc_id"]).select(*COLS).collect()]


def sql(rows):
    documents = table(rows, ["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    return duckdb.sql(ORACLE_SQL["op10_mixing"]).select(*COLS).fetchall()


def test_against_sql(spark):
    rows = [r for r in documents() + odd() if r[0] is not None and (r[0], r[1]) != (900_050, odd()[10][1])]
    assert sorted(run(frame(spark, rows))) == sorted(sql(rows))


def test_near_target_within_bounds_and_repeatable(spark):
    rows = documents()
    got = run(frame(spark, rows))
    assert got and sorted(got) == sorted(run(frame(spark, rows[::-1], parts=3)))
    assert all(c <= 2 for *_, c in got)
    by = {}
    source = {d: s for d, _, _, s, _ in rows}
    for d, n, total, target, taken, c in got:
        assert taken == n * c
        by.setdefault(source[d], []).append((taken, target, total, n))
    for rows_ in by.values():
        target, total = rows_[0][1], rows_[0][2]
        assert target <= 2 * total and abs(sum(x[0] for x in rows_) - target) <= 2 * max(x[3] for x in rows_)


def test_odd_rows_clashes_and_empty(spark):
    rows = documents()[:60] + odd()
    out = mix_sources(with_clashes(frame(spark, rows), "size target copies taken _h _id _one _cell _rank _offset _per _u _first _source _name"), keep=["doc_id"])
    assert out.count() == len(rows)
    assert mix_sources(frame(spark, [], parts=1)).count() == 0
