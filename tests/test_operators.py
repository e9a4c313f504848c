"""Operators that SQL does not cover, odd input, files, and the streaming path."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import extraction, graph, packing, selection, state
from corpusloom.operators.classify import Model, Rule, classified
from corpusloom.sources import files
from corpusloom.streaming.incremental import checkpoint_counts, index_stream


def test_degree_caps_against_a_plain_loop(spark):
    rows = [("g" + str(i % 3), (i * 7) % 11, 100 + (i * 5) % 13, float((i * 31) % 97)) for i in range(300)]
    got = {tuple(r) for r in graph.degree_capped(spark.createDataFrame(rows, "grp string, src long, dst long, score double").distinct(), "grp", 12, 3).collect()}
    want, taken, degree = set(), {}, {}
    for g, s, d, x in sorted(set(rows), key=lambda r: (r[0], -r[3], r[1], r[2])):
        if taken.get(g, 0) < 12 and degree.get((g, s), 0) < 3 and degree.get((g, d), 0) < 3:
            want.add((g, s, d, x))
            taken[g] = taken.get(g, 0) + 1
            degree[g, s], degree[g, d] = degree.get((g, s), 0) + 1, degree.get((g, d), 0) + 1
    assert got == want


def test_two_caps_are_filled_together(spark):
    from corpusloom.operators.greedy import greedy_capped, slot

    rows = sorted({((i * 7) % 13, (i * i * 3 + i) % 9) for i in range(200)}) + [(5, 2), (None, 1), (3, None)]
    df = spark.createDataFrame(rows, "src long, dst long")
    got = greedy_capped(df, [F.col("dst"), F.col("src")], [slot("s", 2, "src"), slot("t", 4, "dst")]).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[0] is not None, r[0] or 0)
    want, places = [], {}
    for s, d in sorted(rows, key=key):
        if places.get(("s", s), 0) < 2 and places.get(("t", d), 0) < 4:
            want.append((s, d))
            places["s", s], places["t", d] = places.get(("s", s), 0) + 1, places.get(("t", d), 0) + 1
    assert sorted(map(tuple, got), key=key) == want
    assert greedy_capped(df.limit(0), [F.col("src")], [slot("s", 2, "src")]).isEmpty()


def test_first_of_greedy_choice_looks_ahead_as_far_as_it_needs(spark, monkeypatch):
    """Far more rows are dropped before the cap is filled than the first beginning holds; no more are taken up than needed."""
    from corpusloom.operators import greedy as G

    rows = [(g, s, 1000 * s + i) for g in "ab" for s in range(9) for i in range(60)]
    df = spark.createDataFrame(rows, "grp string, src long, dst long")
    order, looked_at = [F.col("src"), F.col("dst")], []
    whole = G.greedy_capped
    monkeypatch.setattr(G, "greedy_capped", lambda rows, *a: looked_at.append(rows.count()) or whole(rows, *a))
    want = {(g, s, 1000 * s + i) for g in "ab" for s in range(5) for i in range(2)}
    assert {tuple(r) for r in G.greedy_first(df, order, [G.slot("s", 2, "grp", "src")], 10, "grp").collect()} == want
    assert looked_at == [60, 960]
    got = G.greedy_first(df.where("grp = 'a'"), order, [G.slot("s", 2, "src")], 100).collect()  # fewer than asked for
    assert len(got) == 18 and G.greedy_first(df.limit(0), order, [G.slot("s", 2, "src")], 5).count() == 0


def test_capped_references_do_not_fill_the_caps_of_all_rows(spark, monkeypatch):
    from corpusloom.operators import greedy as G
    from corpusloom.operators import symbols

    seen, whole = [], G.greedy_capped
    monkeypatch.setattr(G, "greedy_capped", lambda rows, *a: seen.append(rows.count()) or whole(rows, *a))
    texts = spark.range(500).selectExpr("printf('t%04d', id) AS ref", "'' AS title", "'loadALedger' AS body")
    files = spark.createDataFrame([("s", "s.go", ["loadALedger"])], "source string, path string, symbols array<string>")
    assert [r.ref for r in symbols.reference_edges(texts, files, to_source=400, most=5).collect()] == [f"t{i:04d}" for i in range(5)]
    assert seen == [15]


def test_first_fit_keeps_the_first_row_if_none_fits(spark):
    rows = [("a", 1, 50), ("a", 2, 70), ("a", 3, 40), ("b", 1, 500), ("b", 2, 300), ("c", 1, 200), ("c", 2, 90)]
    got = sorted(map(tuple, packing.first_fit(spark.createDataFrame(rows, "g string, rank long, n long"), "g", "n", 100).collect()))
    assert got == [("a", 1, 50), ("a", 3, 40), ("b", 1, 500), ("c", 2, 90)]


def test_markdown_of_odd_documents(spark):
    body = "intro\r\n# A\ntext\n## B ##\n```\n# no\n- [ ] no\n```\n> - [ ] quoted\n- [x] done item\n# C\n## Acceptance criteria\n* [ ] must"
    df = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "no heading")], "id long, body string")
    s = [(r.id, r.title, r.heading_path, r.start_line, r.end_line) for r in extraction.sections(df, "id").orderBy("id", "ordinal").collect()]
    assert s == [(1, "A", "A", 2, 3), (1, "B", "A > B", 4, 10), (1, "C", "C", 11, 11), (1, "Acceptance criteria", "C > Acceptance criteria", 12, 13)]
    c = [(r.line_no, r.done, r.text, r.criteria_kind) for r in extraction.checklist(df, "id").orderBy("line_no").collect()]
    assert c == [(10, True, "done item", None), (13, False, "must", "acceptance")]


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("docs/**/a.md", "docs/a.md", True), ("docs/**/a.md", "docs/x/y/a.md", True), ("*.md", "x/a.md", False), ("?.md", "a.md", True), ("a+b(1).md", "a+b(1).md", True), ("src/**", "src/x/y", True)],
)
def test_globs(spark, pattern, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(X.glob_matches("p", pattern)).first()[0] is hit


def test_text_functions(spark):
    r = spark.createDataFrame([("parseHTTPRequest_v2", "abababab", None)], "a string, b string, c string").select(
        X.identifier_parts("a").alias("parts"), X.occurrences("b", "ab").alias("n"), X.occurrences("b", "ab", 3).alias("capped"), X.token_estimate("c").alias("none"), X.content_hash(F.lit("x \r\ny\t")).alias("h"), X.content_hash(F.lit("x\ny")).alias("k"), X.shortened(F.lit("é" * 9), 5).alias("cut")
    ).first()
    assert r.parts == ["parse", "httprequest", "v2"] and (r.n, r.capped, r.none) == (4, 3, 0)
    assert r.h == r.k and r.cut == "éééé…"


def test_classifier_without_predicate_never_matches(spark):
    df = spark.createDataFrame([(1, "docs/a.md", "T", "b", "plan"), (2, None, None, None, None)], "id long, path string, title string, body string, kind string")
    got = {r.id: (r.classifier, r.confidence) for r in classified(df, [Model("m", prior=(Rule(0.9),)), Model("n", prior=(Rule(0.5, path_glob=("docs/**",)),))], "id").collect()}
    assert got == {1: ("n", 0.5), 2: ("none", 0.0)}


def test_inventory_and_ignore_rules(spark, tmp_path):
    for p, t in {"a.md": "# A", "docs/b.md": "b é", "node_modules/x.md": "no", "docs/c.txt": "c", "build/d.md": "d"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t, encoding="utf-8")
    got = files.inventory(spark, str(tmp_path), "*.md").where(~files.ignored("path", "build/\n!keep")).select("path", "size", "body").collect()
    assert sorted(map(tuple, got)) == [("a.md", 3, "# A"), ("docs/b.md", 4, "b é")]
    assert files.stale(files.inventory(spark, str(tmp_path)), F.lit("2000-01-01").cast("timestamp")).first()[0] is True


def test_state_operators(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, d string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "y")], "k long, d string")
    assert {r.k: r.state for r in state.upsert_states(cur, new, "k", "d").collect()} == {1: "unchanged", 2: "updated", 3: "missing", 4: "new"}
    assert sorted(map(tuple, state.insert_or_ignore(cur, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "y")]
    assert sorted(map(tuple, state.replace_scope(cur, new, ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "c"), (4, "y")]


def test_index_stream_upserts_by_content(spark, tmp_path):
    schema = "path string, body string, seen_at timestamp"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    batches = [[("a", "one", 1), ("b", "two", 1), ("a", "one!", 2)], [("a", "one!", 3), ("b", "new", 3), ("c", "x", 3)]]
    for rows in batches:
        spark.createDataFrame([(p, b, f"2024-01-01 00:00:0{t}") for p, b, t in rows], "path string, body string, t string").select("path", "body", F.col("t").cast("timestamp").alias("seen_at")).coalesce(1).write.mode("append").parquet(src)
        index_stream(spark.readStream.schema(schema).parquet(src), out, ck).awaitTermination(60)
    got = {r.path: (r.body, r.revision) for r in spark.read.parquet(f"{out}/v=2").collect()}
    assert got == {"a": ("one!", 1), "b": ("new", 2), "c": ("x", 1)}


def test_windows_of_a_stream_equal_those_of_the_table(spark, sf, tmp_path):
    cols = ["stage", "created_at", "score"]
    df = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("created_at"), F.col("value").alias("score"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).select(*cols)
    q = checkpoint_counts(stream, "1 day", "1 hour").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda rows: sorted((r.stage, r.start, r.n, round(r.score, 6)) for r in rows)
    assert key(spark.table("win").collect()) == key(checkpoint_counts(df, "1 day", "1 hour").collect())


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_history_shapes_and_cochange_scores(spark):
    from corpusloom.operators import history

    rows = [(0, True, False, 1), (1, True, False, 1), (2, True, True, 3), (2, False, True, 2), (2, False, True, 1), (9, False, False, 2), (9, False, False, 1)]
    df = spark.createDataFrame(rows, "total int, shallow boolean, dense boolean, evidence int").withColumn("shape", history.history_shape(F.col("total"), F.col("shallow")))
    weight, confidence = history.cochange_score(F.col("shape"), F.col("dense"), F.col("evidence"))
    got = [tuple(r) for r in df.select("shape", weight, confidence).collect()]
    assert got == [("full", 0.56, 0.64), ("single_commit", 0.36, 0.48), ("shallow", 0.36, 0.48), ("full", 0.58, 0.72), ("full", 0.42, 0.56), ("full", 0.74, 0.86), ("full", 0.56, 0.64)]


def test_commits_of_more_files_than_the_limit_are_dropped(spark):
    from corpusloom.operators import history

    files = spark.createDataFrame([(c, f"src/{i}.go") for c, n in ((1, 32), (2, 33), (3, 2)) for i in range(n)], "commit_id long, path string")
    assert {r.commit_id for r in history.usable_commits(files).select("commit_id").distinct().collect()} == {1, 3}


def test_noise_reasons_in_their_order(spark):
    rows = [("a", 1), ("the", 1), ("the", 7), ("the", 5), ("b", 6), ("c", 2)]
    df = spark.createDataFrame(rows, "concept string, df long")
    got = [r[0] for r in df.select(graph.noise_reason(F.col("df"), F.col("concept"), 12, ("the",))).collect()]
    assert got == ["single_artifact", "single_artifact", "too_many_artifacts", "stop_word", "high_document_frequency", ""]


def test_edge_scores_by_strong_and_semantic_concepts(spark):
    df = spark.createDataFrame([(2, 1, 2.0), (0, 3, 5.0), (3, 0, 1.0), (5, 1, 9.0)], "strong long, semantic long, idf_max double")
    got = [(round(r.weight, 3), round(r.confidence, 3)) for r in graph.edge_scores(df).collect()]
    assert got == [(0.7, 0.86), (0.7, 0.83), (0.72, 0.84), (1.0, 1.0)]


def test_archived_paths_have_a_class_of_their_own(spark):
    from corpusloom.functions import paths

    df = spark.createDataFrame([("archive/x.go",), ("docs/archived/y.md",), ("vendor/z.go",), ("src/a.go",)], "path string")
    assert [r[0] for r in df.select(paths.path_class("path")).collect()] == ["archive", "archive", "noise", "source"]


def test_search_shuffles_hits_only(spark, sf):
    from corpusloom.plans import search

    plan = search.find_bm25_top20(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 8 and "BroadcastHashJoin" in plan


def test_two_tiers_give_each_item_its_least(spark):
    rows = [("r", i, float((i * 7 + j * 13) % 50)) for i in range(6) for j in range(8)] + [("s", 1, 3.0), ("s", 1, 2.0)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "g string, item long, w double, n long")
    ranked = {}
    for n, (g, item, w) in enumerate(rows):
        ranked.setdefault((g, item), []).append((-w, n))
    for least, most in ((2, 20), (2, 9), (3, 100)):
        want = set()
        for g in "rs":
            tiers = sorted((place >= least, *x) for k, v in ranked.items() if k[0] == g for place, x in enumerate(sorted(v)))
            want |= {n for *_, n in tiers[:most]}
        got = selection.two_tier(df, "g", "item", [F.desc("w"), F.col("n")], least, most, salts=3)
        assert {r.n for r in got.collect()} == want


def test_quotas_refill_with_the_best_of_the_rest(spark):
    df = spark.createDataFrame([("a", i, 10 - i) for i in range(6)] + [("b", 10, 1), ("c", 11, 99)], "role string, k long, score long")
    got = {(r.k, r.refill) for r in selection.quota_refill(df, "role", "k", [F.desc("score"), F.col("k")], {"a": 2, "b": 2}, 5).collect()}
    assert got == {(0, False), (1, False), (10, False), (11, True), (2, True)}


def test_labels_buckets_and_identities(spark):
    one = spark.range(1)
    label = lambda h, of: one.select(selection.heading_label(F.lit(h), of)).first()[0]
    assert [label(h, selection.SECTION_KINDS) for h in ("Open Questions", "Risk and Decision", "Intro")] == ["risk", "decision", ""]
    assert [label(h, selection.SECTION_ROLES) for h in ("Non-Goals", "Rollout plan", "x")] == ["product", "tasks", ""]
    tag = lambda p: one.select(F.lit(p).alias("p")).select(selection.directory_tag("p")).first()[0]
    assert [tag(p) for p in ("docs/plans/001-login/api/x.md", "x.md", "docs/x.md", "a/b/c.md")] == ["api", "", "", "a"]
    assert [r[0] for r in spark.range(0, 600, 100).select(selection.count_bucket(F.col("id"))).collect()] == ["0", "51-100", "101-500", "101-500", "101-500", "101-500"]
    assert one.select(selection.duration_bucket(F.lit(130_500))).first()[0] == "130s+"
    a = spark.createDataFrame([("A/x.md#L3",), ("a/y.md#L3-L9",), ("a/z.md#Lx",)], "path string")
    b = spark.createDataFrame([("a/x.md",), ("a/y.md#L4",), ("a\\z.md",), ("a/x.md#l3",)], "path string")
    assert {tuple(r) for r in selection.identity_matches(a, b).collect()} == {("A/x.md#L3", "a/x.md"), ("A/x.md#L3", "a/x.md#l3")}


def test_numbers_go_on_across_ranges(spark):
    at = [3, 0, 17, 5, 99, 42, 41, 40, -7]
    got = selection.numbered(spark.createDataFrame([(i,) for i in at], "pos long"), "pos", "n", width=10).collect()
    assert sorted((r.n, r.pos) for r in got) == list(enumerate(sorted(at), 1))
