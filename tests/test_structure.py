"""Ignore stack, positional search, excerpts, imports and separate areas against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import areas as A
from corpusloom.operators import imports as I
from corpusloom.operators import positions as P
from corpusloom.operators.excerpts import excerpt
from corpusloom.sources import ignore

RULES = "repo string, path string, body string"


def decided(spark, paths, **files):
    names = {"top": ".gitignore", "exclude": ".git/info/exclude", "ai": ".aiignore"}
    rows = [("r", names.get(k, k), v) for k, v in files.items()]
    got = ignore.ignored(spark.createDataFrame([("r", p) for p in paths], "repo string, path string"), spark.createDataFrame(rows, RULES))
    return {r.path: r.ignored for r in got.collect()}


@pytest.mark.parametrize(
    ("rule", "hits", "misses"),
    [
        ("dist/", ["dist/a.js", "web/dist/a.js"], ["dist", "distant/a.js"]),
        ("*.log", ["a.log", "x/y/b.log", "b.log/c"], ["a.logs", "log"]),
        ("/build", ["build", "build/x"], ["src/build/x", "builds"]),
        ("docs/*.md", ["docs/a.md"], ["docs/sub/a.md", "x/docs/a.md"]),
        ("docs/**", ["docs/a", "docs/b/c"], ["docs", "x/docs/a"]),
        ("**/tmp", ["tmp", "a/b/tmp/c"], ["a/tmps"]),
        ("a/**/z", ["a/z", "a/b/c/z"], ["a/bz"]),
        ("unit?.go", ["unit1.go", "x/unit2.go"], ["unit10.go"]),
        ("u[0-4].go", ["u3.go"], ["u5.go"]),
        ("u[!0-4].go", ["u5.go"], ["u3.go"]),
        ("a+b(c).md  ", ["a+b(c).md"], ["aab(c).md"]),
        (r"\#x", ["#x"], ["x"]),
    ],
)
def test_rule(spark, rule, hits, misses):
    got = decided(spark, hits + misses, top=f"# comment\n\n{rule}\r\n")
    assert [p for p in hits + misses if got[p]] == hits


def test_the_last_rule_wins_across_files_and_folders(spark):
    paths = ["a.log", "keep.log", "sub/a.log", "sub/keep.log", "sub/deep/a.log", "other/a.txt", "secret.txt"]
    got = decided(spark, paths, top="*.log\n", exclude="!keep.log\n", ai="secret.txt\n", **{"sub/.gitignore": "!a.log\n/keep.log\n", "sub/deep/.gitignore": "*\n", "other/.gitignore": "!*\n"})
    assert [p for p in paths if got[p]] == ["a.log", "sub/keep.log", "sub/deep/a.log", "secret.txt"]


def test_rules_of_no_file_and_blank_rules(spark):
    assert decided(spark, ["a"], **{"README": "a\n"}) == {"a": False}
    assert decided(spark, ["a", "x/b"], top="\n#a\n!\n/\n") == {"a": False, "x/b": False}


def toks(s):
    return [t for t in re.split(r"[^\w]+|_", (s or "").lower()) if t]


def plain_matches(docs, queries):
    out = {}
    for q, text in queries:
        parts = [(toks(c), c.endswith("*")) for c in re.findall(r'"[^"]*"\*?|\S+', text or "")]
        parts = [(w, s) for w, s in parts if w]
        for key, *fields in docs:
            hits = []
            for w, star in parts:
                n = 0
                for f in fields:
                    t = toks(f)
                    n += sum(all((t[i + j].startswith(x) if star and j == len(w) - 1 else t[i + j] == x) for j, x in enumerate(w)) for i in range(len(t) - len(w) + 1))
                hits.append(n)
            if parts and all(hits):
                out[q, key] = sum(hits)
    return out


def test_phrases_and_prefixes(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "abd", "b", "ba", "c"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(4), text(rng.randrange(0, 60))) for i in range(60)] + [(90, None, "ab b"), (91, "b", "ab"), (92, "", "")]
    queries = [(i, q) for i, q in enumerate(['"ab b"', "ab b", '"ab b" c', "ab*", '"b ab"*', '"ab abc b ba"', 'c* "ba ba"', "", None, '"" c', '"c', "zz", "ab.b", "* b"])]
    queries += [(100 + i, f'"{text(3)}" {rng.choice(words)}* {rng.choice(words)}') for i in range(25)]
    got = P.matches(spark.createDataFrame(docs, "id long, title string, body string"), "id", {"title": F.col("title"), "body": F.col("body")}, spark.createDataFrame(queries, "query_id long, text string"))
    assert {(r.query_id, r.id): r.hits for r in got.collect()} == plain_matches(docs, queries)


def test_postings_of_common_words_are_not_shuffled(spark):
    """What is shuffled of documents are counts of words, never a row for a place or for a pair of document and query."""
    docs = spark.range(50).selectExpr("id", "concat(repeat('the of ', 40), 'word', id) AS body")
    queries = spark.createDataFrame([(1, '"the of the" of wor*'), (2, '"of word7" the th*'), (3, "th* w*")], "query_id long, text string")
    found = P.matches(docs, "id", {"body": F.col("body")}, queries)
    assert {(r.query_id, r.id, r.hits) for r in found.collect()} == {(1, i, 39 + 40 + 1) for i in range(50)} | {(2, 7, 1 + 40 + 40)} | {(3, i, 41) for i in range(50)}
    assert not re.search(r"hashpartitioning\([^)]*\bid#", found._jdf.queryExecution().executedPlan().toString())


def test_holding(spark):
    docs = spark.createDataFrame([(1, "An Apple%", None), (2, "x", "an apple pie"), (3, None, None)], "id long, title string, body string")
    queries = spark.createDataFrame([(1, "N APPLE"), (2, "%"), (3, ""), (4, None), (5, "pie x")], "query_id long, text string")
    assert {tuple(r) for r in P.holding(docs, "id", [F.col("title"), F.col("body")], queries).collect()} == {(1, 1), (1, 2), (2, 1)}


def plain_excerpt(text, terms, most):
    body = (text or "").strip()
    if len(body) <= most:
        return body
    lines = body.split("\n")
    near = {j for i, x in enumerate(lines) if any(t and t in x.lower() for t in terms) or re.match(r"\s*[-*] \[[ x]\]", x.lower()) for j in (i - 1, i, i + 1) if 0 <= j < len(lines)}
    if not near:
        return body[:most].strip() + "\n..."
    out, last = "", -2
    for i in sorted(near):
        if len(out) >= most:
            break
        out += ("...\n" if last >= 0 and i > last + 1 else "") + lines[i] + "\n"
        last = i
    out = out.strip()
    return out[:most].strip() + "\n..." if len(out) > most else out


def test_excerpts(spark):
    rng = random.Random(4)
    line = lambda: rng.choice(["", "plain words here", "a Needle in it", "- [ ] task", "  * [X] done", "longer line with nothing of note in it at all"])
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 40))), rng.choice([["needle"], ["zz"], ["", "note"], []])) for i in range(150)] + [(900, None, ["a"]), (901, "x" * 500, []), (902, "\n\n", ["a"])]
    got = spark.createDataFrame(rows, "id long, text string, terms array<string>").select("id", excerpt("text", F.col("terms"), 200).alias("e")).collect()
    assert {r.id: r.e for r in got} == {i: plain_excerpt(t, terms, 200) for i, t, terms in rows}


def test_imports(spark):
    files = ["src/app/main.ts", "src/app/util.ts", "src/lib/index.ts", "lib/net.go", "a/b/core.py", "x/core.py", "pkg/deep/one.py", "pkg/mod/__init__.py", "crate/src/io/file.rs", "crate/src/io.rs", "tests/test_one.py", "src/app/only.vue"]
    specs = [
        ("src/app/main.ts", "./util", "src/app/util.ts"), ("src/app/main.ts", "../lib", "src/lib/index.ts"), ("src/app/main.ts", "@/src/app/only", "src/app/only.vue"), ("src/app/main.ts", "./main", None),
        ("src/app/main.ts", "react", None), ("src/app/main.ts", "../../../../x", None), ("src/app/main.ts", "lib/net", "lib/net.go"), ("tests/test_one.py", "deep.one", "pkg/deep/one.py"), ("tests/test_one.py", "core", None),
        ("tests/test_one.py", "b.core", "a/b/core.py"), ("tests/test_one.py", "pkg.mod", "pkg/mod/__init__.py"), ("crate/src/io.rs", "crate::io::file", "crate/src/io/file.rs"), ("crate/src/io/file.rs", "super::io", "crate/src/io.rs"), ("crate/src/io/file.rs", "super::super::io", None),
        ("src/app/main.ts", "@scope/app/util", "src/app/util.ts"),
    ]
    f = spark.createDataFrame([(p,) for p in files], "path string")
    got = I.resolved(f, spark.createDataFrame([s[:2] for s in specs] + [specs[0][:2], ("src/app/main.ts", " "), ("src/app/main.ts", None)], "path string, spec string"))
    want = {(p, s): t for p, s, t in specs if t}
    assert {(r.path, r.spec): r.target for r in got.collect()} == want
    assert I.suffix_index(f).where("suffix IN ('core', 'core.py')").count() == 0
    cleaned = spark.createDataFrame([("a/./b/../c",), ("../../x",), ("a/../../b",), ("",)], "p string").select(I.cleaned(F.col("p")).alias("c")).collect()
    assert [r.c for r in cleaned] == ["a/c", "../../x", "../b", ""]


def test_what_imports_add_is_capped(spark):
    edges = spark.createDataFrame([(f"tests/test_{i}.py", "src/a.py") for i in range(50)] + [("src/b.py", "src/a.py")], "path string, target string")
    members = spark.createDataFrame([("one", f"tests/test_{i}.py") for i in range(50)] + [("one", "src/a.py"), ("two", "src/a.py"), ("two", "src/b.py")], "area string, path string")
    got = {r.area: (r.imports, r.test_imports, r.score) for r in I.evidence(edges, members).collect()}
    assert got == {"one": (50, 50, round(40 * 0.65 + 16 * 1.4, 6)), "two": (1, 0, 0.65)}


def plans(df):
    """The plan before and after it is adapted, as text."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_grows_with_files_is_not_broadcast(spark):
    """Sides made of a small file by explode look small to the optimizer; a merge join is stated for them."""
    files = spark.range(40).selectExpr("printf('src/unit%d.py', id) AS path").union(spark.range(40).selectExpr("printf('lib/unit%d.go', id)"))
    specs = spark.range(40).selectExpr("printf('src/unit%d.py', id) AS path", "printf('lib/unit%d', (id + 1) % 40) AS spec")
    members = files.selectExpr("explode(array('all', left(path, 3))) AS area", "path")
    edges = I.resolved(files, specs)
    assert edges.count() == 40
    for df in (edges, I.evidence(edges, members)):
        assert "Broadcast" not in plans(df)
    item = members.select("area", F.col("path").alias("item"))
    order = spark.range(1).selectExpr("explode(array(struct('all' AS area, 1 AS place), struct('src' AS area, 2 AS place), struct('lib' AS area, 3 AS place))) AS x").select("x.*")
    shared = A.overlaps(item, order)
    assert {tuple(r) for r in shared.collect()} == {("all", "src"), ("all", "lib")}
    found = shared._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("strategy=merge") == 3, found


def test_parts_are_dealt_by_rows_before_they_become_files(spark, sf, monkeypatch):
    from corpusloom.plans import structure
    from corpusloom.sources import tables as T

    rows = T.table(spark, sf, "part").count()
    whole = {tuple(r) for r in structure.import_suffixes(spark, sf).collect()}
    monkeypatch.setattr(T, "PARTS", 20, raising=False)
    for df in (T.files(spark, sf), T.code_files(spark, sf)):
        assert df.rdd.getNumPartitions() == -(-rows // 20)
    assert {tuple(r) for r in structure.import_suffixes(spark, sf).collect()} == whole


def test_an_import_prefers_the_first_ending(spark):
    files = spark.createDataFrame([("lib/a.py",), ("lib/a.ts",), ("lib/a",), ("lib/b/index.js",), ("lib/b/__init__.py",), ("lib/c.d.ts",), ("x.py",)], "path string")
    specs = spark.createDataFrame([("x.py", "lib/a"), ("x.py", "lib/b"), ("x.py", "lib/c.d"), ("x.py", "lib/c")], "path string, spec string")
    assert {tuple(r) for r in I.resolved(files, specs).collect()} == {("x.py", "lib/a", "lib/a"), ("x.py", "lib/b", "lib/b/index.js"), ("x.py", "lib/c.d", "lib/c.d.ts")}


def plain_separate(areas, members, most, least):
    sets = {}
    for a, i in members:
        sets.setdefault(a, set()).add(i)
    out = []
    for score, a in sorted((-s, a) for a, s in areas):
        x = sets.get(a, set())
        if not any(x and sets.get(b) and len(x & sets[b]) / min(len(x), len(sets[b])) >= least for b in out):
            out.append(a)
    return out[:most]


@pytest.mark.parametrize("seed", range(3))
def test_separate_areas(spark, seed):
    rng = random.Random(seed)
    members = sorted({(f"a{rng.randrange(40)}", rng.randrange(60)) for _ in range(500)})
    areas = [(f"a{i}", float(rng.randrange(4))) for i in range(45)]
    got = A.separate(spark.createDataFrame(areas, "area string, score double"), spark.createDataFrame(members, "area string, item long"), [-F.col("score")], 30, 0.4)
    assert [r.area for r in got.collect()] == plain_separate(areas, members, 30, 0.4)


def test_rounds_of_a_chain_and_of_random_conflicts(spark, monkeypatch):
    rounds = 0
    plain = A.checkpointed

    def counted(df):
        nonlocal rounds
        rounds += 1
        return plain(df)

    monkeypatch.setattr(A, "checkpointed", counted)
    nodes = lambda n: spark.createDataFrame([(i,) for i in range(n)], "area long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(11)], "before long, after long")
    assert sorted(r.area for r in A.greedy_independent(nodes(12), chain).collect()) == list(range(0, 12, 2))
    assert rounds <= 3 * 6 + 2
    rng, rounds = random.Random(7), 0
    pairs = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(900)}
    taken = []
    for i in range(300):
        if not any((j, i) in pairs for j in taken):
            taken.append(i)
    got = A.greedy_independent(nodes(300), spark.createDataFrame(sorted(pairs), "before long, after long"))
    assert sorted(r.area for r in got.collect()) == taken and rounds <= 3 * 12
    assert A.greedy_independent(nodes(0), chain.limit(0)).count() == 0
