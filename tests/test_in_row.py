"""Work whose memory is bounded in a task: plans are dealt to tasks by their rows."""

from __future__ import annotations

import re

import duckdb

from corpusloom.plans import history as H
from corpusloom.plans import search
from corpusloom.sources import tables as T


def test_plans_are_dealt_by_rows(spark, sf, monkeypatch):
    """Windows over lines stay in tasks of few plans."""
    orders = T.table(spark, sf, "orders").count()
    monkeypatch.setattr(T, "PLANS", 50)
    assert T.markdown(spark, sf).rdd.getNumPartitions() == -(-orders // 50) > 8


def test_paths_of_changes_are_not_broadcast(spark, sf):
    """The paths of changed files grow with the parts: no task holds them all."""
    plan = T.commit_files(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_changes_are_dealt_by_rows(spark, sf, monkeypatch):
    """Repeated changes of a path are told apart in tasks of few changes."""
    lines = T.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(T, "CHANGES", 100)
    plan = H.recently_changed(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning(path, {-(-lines // 100)})" in re.sub(r"#\d+", "", plan)


def test_scores_stay_with_their_documents(spark, sf):
    """Hits and pairs of queries and documents (or lines) are not shuffled: documents are, once dealt by doc_id."""
    for scores in (search._scores, search._section_scores):
        plan = re.sub(r"#\d+L?", "", scores(spark, sf)._jdf.queryExecution().executedPlan().toString())
        assert set(re.findall(r"hashpartitioning\((\w+)", plan)) == {"doc_id", "term"} and "hashpartitioning(doc_id, term" not in plan
        assert "SortMergeJoin" not in plan


def test_documents_without_id_count_in_the_corpus_only(spark, tmp_path):
    rows = [(1, "ring of iron\nblue ring"), (2, "bolt"), (3, None), (4, "iron\n\niron bolt"), (None, "ring ring\nbolt")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "ring the bolt"), (8, "iron")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for query in (search.bm25_docs, search.bm25_sections, search.find_bm25_top20):
        got = query(spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({search.SQL[query.__name__]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and want
