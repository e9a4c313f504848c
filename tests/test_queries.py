"""Every query with SQL gives the rows that DuckDB gives for it, over the whole tables of the smallest scale."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from corpusloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.all_queries()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return float(v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def kind(v):
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else type(v).__name__


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf, duck):
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in got.collect()]
    out = duck.execute(SQL[name])
    cols = [d[0] for d in out.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    want = [tuple(plain(r[i]) for i in at) for r in out.fetchall()]
    a, b = Counter(rows), Counter(want)
    assert a == b, f"{len(rows)} and {len(want)} rows of {names}; only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
    assert want, "no rows: the query tests nothing"
    assert [{kind(v) for v in c} for c in zip(*rows, strict=True)] == [{kind(v) for v in c} for c in zip(*want, strict=True)]


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) <= {"anchor_reranked", "symbol_edges", "edges_degree_capped", "pack_first_fit", "checkpoint_windows_stream"}
