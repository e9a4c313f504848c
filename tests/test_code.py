"""Test units, comments, imports and path terms of small files in each language, and odd input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.operators import code
from corpusloom.operators import search as S
from corpusloom.plans import code as P

FILES = {
    "a_test.go": "package a\nfunc TestOne(t *testing.T) {\n}\nfunc helper() {}\n  func TestTwo(t *testing.T) {}\n",
    "test_b.py": "def test_free():\n  pass\nclass TestB(Base):\n  def test_in(self): pass\n  def helper(self): pass",
    "c.spec.ts": "describe('outer', () => {\n  it.only(\"says \\\"hi\\\"\", f)\n  test(`more`, g)\n  it(x, 'no')\n",
    "D.java": "public class D {\n  @Test\n\n  @Fast\n  public void works() {\n    x = y.call();\n  }\n  void testPlain() {}\n  void other() {}\n",
    "e.kt": "class E {\n  @Test\n  fun `does a thing`() {\n  }\n  fun testShort() = 1\n",
    "f.rb": "describe 'Thing' do\n  context \"when x\" do\n    it 'runs' do\n  it('also') { }\n  it (\"no\")\n",
    "g.php": "#[Test]\npublic function checks() {}\nfunction testOther() {}\n#[Test]\n\nfunction late() {}\n",
    "h.rs": "#[test]\n#[ignore]\nfn checks() {\n}\nfn not_a_test() {}\n#[tokio::test]\nasync fn waits() {}\n",
    "notes.txt": "func TestNo(t)\n",
    "src/x.js": "it('is no test file', f)",
}
UNITS = {
    ("a_test.go", "TestOne", "", 2, 4), ("a_test.go", "TestTwo", "", 5, 6),
    ("test_b.py", "test_free", "", 1, 3), ("test_b.py", "test_in", "TestB(Base)", 4, 5),
    ("c.spec.ts", 'says \\"hi\\"', "outer", 2, 2), ("c.spec.ts", "more", "outer", 3, 5),
    ("D.java", "works", "D", 2, 7), ("D.java", "testPlain", "D", 8, 10),
    ("e.kt", "does a thing", "E", 2, 4), ("e.kt", "testShort", "E", 5, 6),
    ("f.rb", "runs", "when x", 3, 3), ("f.rb", "also", "when x", 4, 6),
    ("g.php", "checks", "", 2, 2), ("g.php", "testOther", "", 3, 7),
    ("h.rs", "checks", "", 1, 5), ("h.rs", "waits", "", 6, 8),
}


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, body string")


def test_units_by_language(spark):
    got = code.test_units(table(spark, [*FILES.items(), ("empty_test.go", ""), ("null_test.go", None)])).collect()
    assert {(r.path, r.name, r.parent, r.start_line, r.end_line) for r in got} == UNITS
    long = "func TestA() {\n" + "x\n" * 500
    assert [r.end_line for r in code.test_units(table(spark, [("l_test.go", long)])).collect()] == [120]


def test_comments_and_their_roles(spark):
    go = "// Copyright 2020 someone\n\n// because of x\n// and y\nvar a int // never seen\n/* must always\n * hold // this\n/* still inside\n*/\n// short\n/* TODO: one line */ x\n// never mind\n/* open todo here\n\nend"
    py = "#!/usr/bin/env todo\n# why this is\n#\n# done\nx = 1\n// never a comment\n"
    got = {(r.path, r.start_line, r.end_line, r.role, r.text) for r in code.intent_comments(table(spark, [("a.go", go), ("b.py", py), ("c.go", None), ("d.go", "")])).collect()}
    assert got == {
        ("a.go", 3, 4, "rationale", "because of x\nand y"), ("a.go", 6, 9, "invariant", "must always\nhold // this\n/* still inside"), ("a.go", 11, 11, "todo", "TODO: one line"),
        ("a.go", 13, 15, "todo", "open todo here\nend"), ("b.py", 2, 4, "rationale", "why this is\ndone"),
    }


def test_manifest_rows(spark):
    body = "import zeta\nfrom src.b import c\nimport './near'\nconst q = require('react');\nuse crate::k;\n#include <stdio.h>\nimport java.util.List;\nimport aaa\nclass Foo(Bar):\n  def test_it(self): pass\ntype T struct\n"
    r = code.manifest(table(spark, [("Src/my-App/_Foo.Bar_.py", body), ("x", None)])).orderBy("path").collect()
    assert r[0].imports == ["crate::k", "src.b", "aaa", "java.util.List", "react", "stdio.h"]
    assert r[0].symbols == ["T", "Foo", "test_it", "q"] and r[0].tests == ["test_it"]
    assert r[0].terms == ["app", "bar", "foo", "foo.bar", "my", "py", "src"]
    assert (r[1].imports, r[1].symbols, r[1].terms) == ([], [], ["x"])


def test_best_by_groups(spark):
    """Groups of documents give the best of each query as all documents do; names of files are not looked for in a filter."""
    rng = random.Random(5)
    docs = [(f"d{i:03}", rng.choice(["", None, "!", *[" ".join(rng.choices(["ring", "bolt", "blue", "zz", f"u{i}"], k=rng.randrange(1, 6))) for _ in range(12)]])) for i in range(200)]
    d = spark.createDataFrame(docs, "path string, text string")
    q = spark.createDataFrame([(1, "ring"), (1, "blue"), (2, "bolt"), (3, "none"), (4, "u7")], "query_id long, term string")
    want = S.top_per(S.bm25(d, "path", F.col("text"), q), "query_id", [F.desc("score"), F.col("path")], 5)
    got = S.bm25_best(d, "path", F.col("text"), q, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count() > 10


def test_names_are_found_in_no_filter(spark, sf):
    for query in (P.manifest_search, P.manifest_counts):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "include" in line]
