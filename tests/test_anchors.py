"""Anchor scores of all modes, and what they add to found rows, against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import anchors as A
from corpusloom.operators import candidates as C
from corpusloom.plans import anchors as P

QUERIES = "query_id long, text string"
ROWS = "id long, path string, title string, body string, test string"


def parts(t):
    t = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t)
    return [x for x in re.split(r"[^a-z0-9]+", t.lower()) if x]


def named(t):
    return re.sub("^[`'\"]+|[`'\"]+$", "", t.strip().lower())


def compact(t):
    return "".join(parts(t)) or named(t)


def toks(t):
    return re.findall(r"[A-Za-z0-9_./\\-]+", t)


def text_terms(t):
    return [x for x in [named(t), *(y for k in toks(t) for y in [named(k), *parts(k), compact(k)])] if x]


def path_terms(p):
    bare = lambda s: re.sub(r"\.[^.]*$", "", s)
    return text_terms(p) + text_terms(bare(p.split("/")[-1])) + [x for s in p.split("/") for x in text_terms(bare(s))]


def profile(text):
    out = []
    for m in re.finditer(r"\"[^\"]*\"|'[^']*'", text or "", re.S):
        out.append(("phrase", named(m[0][1:-1].strip())))
    for t in toks(text or ""):
        low = t.lower()
        if low in A.TASK_WORDS:
            continue
        if low in A.ROLE_WORDS:
            out.append(("role", low))
        elif re.search(r"[/\\_.-]", t):
            out.append(("path", low))
            if compact(t) not in ("", low):
                out.append(("compact", compact(t)))
        elif (len(t) >= 8 and ((t != low and t != t.upper()) or re.search(r"\d", t))) or (len(low) >= 9 and re.fullmatch(r"test[a-z0-9]*[a-z][a-z0-9]*", low)):
            out.append(("compact", compact(t)))
            if low not in A.BROAD_WORDS:
                out.append(("rare", low))
        elif low in A.BROAD_WORDS:
            out.append(("role", low))
        elif len(low) >= 4:
            out.append(("rare", low))
    return [(k, t) for k, t in dict.fromkeys(out) if t]


def single(t):
    if len(t) < 5:
        return None
    for end, cut, add in (("ies", 3, "y"), ("sses", 2, ""), ("ses", 2, ""), ("xes", 2, ""), ("zes", 2, ""), ("ches", 2, ""), ("shes", 2, "")):
        if t.endswith(end) and (end != "ies" or len(t) > 5):
            return t[:-cut] + add
    return t[:-1] if t.endswith("s") and not t.endswith("ss") else None


def fields_of(r):
    _, path, title, body, test = r
    names = [x for x in ["".join(parts(test)), re.sub("^test(?=.)", "", "".join(parts(test))), *parts(test)] if x] if test else []
    return {"path": Counter(path_terms(path)), "title": Counter(text_terms(title)), "test_name": Counter(names), "body": Counter(text_terms(body))}


def plain_scores(queries, rows, mode):
    m, n = A.MODES[mode], len(rows)
    held = {r[0]: fields_of(r) for r in rows}
    df = Counter(t for f in held.values() for t in {t for k, c in f.items() if k != "body" for t in c} if (len(t) >= 3 or t in A.ROLE_WORDS) and t not in A.TASK_WORDS)
    idf_of = lambda t: math.log((1 + n) / (1 + df[t])) + 1
    out = {}
    for q, text in queries:
        a = profile(text)
        if all(k == "role" for k, _ in a):
            continue
        for key, f in held.items():
            score, got, strong, top = 0.0, [], False, 0.0
            for kind, t in a:
                alt = single(t) if m.code else None
                mod = {"role": m.of_broad if t in A.BROAD_WORDS else m.of_role, "compact": m.compact, "path": m.path, "phrase": m.phrase, "rare": 0.0 if m.code and t in A.CODE_WORDS else m.rare}[kind]
                tf, where = 0.0, set()
                for name, c in f.items():
                    count = c[t] or (c[alt] if alt else 0)
                    if not count:
                        continue
                    if " " in t:
                        w = {**A.PHRASE_FIELDS, "body": m.phrase_body}.get(name, 0)
                        tf, where = tf + count * w, where | ({name} if w else set())
                    else:
                        w, most = {**A.FIELDS, "body": (m.body, A.MOST_BODY_HITS)}[name]
                        tf, where = tf + min(count, most) * w, where | {name}
                if tf <= 0 or mod <= 0:
                    continue
                idf = idf_of(t) if df[t] else 0.0
                if alt and df[alt] and (not df[t] or idf_of(alt) > idf):
                    idf = idf_of(alt)
                stats, idf = idf, idf or 1.0
                worth = tf * (1.25 if kind == "compact" else 1) * (max(idf - 1, 1.0) if kind == "compact" else max(idf - 1, 0)) * mod
                if worth <= 0:
                    continue
                if kind == "role" and all(k == "role" for k, *_ in got):
                    worth *= 0.25
                if kind != "role" and t not in A.BROAD_WORDS and not (mode == "strict" and kind == "rare") and not (0 < stats < 1.8 and kind != "compact") and where & {"path", "title", "test_name"}:
                    strong = True
                score, top = score + worth, max(top, idf)
                got.append((kind, t, where))
            if got:
                lead = next((t for k, t, _ in got if k != "role" and t not in A.SUPPORT_WORDS and t not in A.CODE_WORDS), None)
                out[q, key] = (round(score, 6), [*dict.fromkeys(t for _, t, _ in got)], sorted(set().union(*(w for *_, w in got))), strong, lead, top, {k for k, *_ in got})
    return out


def data():
    rng = random.Random(9)
    names = ["TestLedgerReplay", "ledgerService", "policies", "statuses", "webhook", "api", "design", "stripe_event_id", "retries", "classes", "boxes", "ledger", "replay", "model", "x9y8z7w6"]
    pick = lambda n: " ".join(rng.choice(names) for _ in range(n))
    rows = [(i, f"{rng.choice(['src', 'docs', 'pkg'])}/{rng.choice(names)}/{rng.choice(names)}.{rng.choice(['go', 'md'])}", pick(rng.randrange(1, 4)), pick(rng.randrange(0, 30)), rng.choice([None, rng.choice(names)])) for i in range(60)]
    rows += [(90, "CLAUDE.md", "ledger replay", "ledger", None), (91, "docs/a.md", "ledger replay", "", None)]
    queries = [(i, f"{pick(2)} {rng.choice(['policy', 'boxes', 'plan', 'the api', 'src/ledger.go'])} {pick(1)}") for i in range(15)]
    return queries + [(50, '"ledger replay" webhooks'), (51, "design plan"), (52, None), (53, ""), (54, "'Ledger Replay' rules"), (55, "the how")], rows


def scored(spark, queries, rows, mode):
    fields = {"path": A.path_terms(F.col("path")), "title": A.text_terms(F.col("title")), "test_name": F.when(F.col("test").isNotNull(), A.test_terms(F.col("test"))).otherwise(F.array().cast("array<string>")), "body": A.text_terms(F.col("body"))}
    return A.scores(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(rows, ROWS), "id", fields, mode)


@pytest.mark.parametrize("mode", ["v1", "strong_field", "strict", "code_task_family_v2"])
def test_scores(spark, mode):
    queries, rows = data()
    got = {(r.query_id, r.id): (r.score, r.matches, r.fields, r.strong, r.lead) for r in scored(spark, queries, rows, mode).collect()}
    want = {k: v[:5] for k, v in plain_scores(queries, rows, mode).items()}
    assert got.keys() == want.keys() and len(want) > 100
    for k, w in want.items():
        assert got[k][1:] == w[1:] and abs(got[k][0] - w[0]) < 1e-4, (k, got[k], w)


def test_profile(spark):
    texts = ["fix the TestLedgerReplay in src/app/ledger.go", 'a "two words" plan', "api design", "testledgerreplay42 x", "Ledger LEDGERSERVICE", ""]
    got = {}
    for r in A.query_anchors(spark.createDataFrame(list(enumerate(texts)), QUERIES)).orderBy("query_id", "ord").collect():
        got.setdefault(r.query_id, []).append((r.kind, r.term))
    assert got == {i: profile(t) for i, t in enumerate(texts) if profile(t)}
    assert ("phrase", "two words") in got[1] and ("path", "src/app/ledger.go") in got[0] and ("compact", "testledgerreplay") in got[0]


@pytest.mark.parametrize("mode", ["v1", "strict", "code_task", "code_task_family_v2", "rerank_only"])
def test_reranked(spark, mode):
    queries, rows = data()
    paths = {r[0]: r[1] for r in rows}
    rng = random.Random(2)
    found = [(q, i, paths[i], float(rng.randrange(4, 20))) for q, _ in queries for i in rng.sample(sorted(paths), 6)]
    s = plain_scores(queries, rows, mode)
    m = A.MODES[mode]
    instruction = lambda p: p.split("/")[-1].lower() == "claude.md"
    want = []
    for q, text in queries:
        about_rules = any(t in A.PROTOCOL_WORDS for _, t in profile(text))
        own = [r for r in found if r[0] == q]
        for _, i, p, score in own:
            x = s.get((q, i))
            if x and not (instruction(p) and not about_rules) and x[0] >= 1 and (mode != "code_task_family_v2" or x[4]):
                named_kind = bool(x[6] & {"compact", "path", "phrase"})
                rest = x[0] >= 4 and x[5] >= 1.25 and bool(set(x[2]) & {"path", "title"}) and x[6] != {"role"} if m.code else named_kind and bool(set(x[2]) & {"path", "title", "test_name"})
                if x[3] or rest:
                    score += min(x[0], 24.0)
            want.append((q, i, round(score, 4), False))
        new = []
        for (q2, i), x in s.items():
            if q2 != q or i in [r[1] for r in own] or (instruction(paths[i]) and not about_rules) or not x[3] or x[0] < m.least_score or x[5] < m.least_idf:
                continue
            at = set(x[2])
            ok = {"v1": True, "strict": bool(at & {"path", "title", "test_name"}) and bool(x[6] & {"compact", "path", "phrase"}), "code_task_family_v2": bool(at & {"path", "title", "test_name"}) and bool(x[4])}.get(mode, bool(at & {"path", "title"}))
            if ok:
                new.append((-round(min(x[0], 24.0), 6), paths[i], i, x[4]))
        new.sort()
        if mode == "code_task_family_v2":
            seen, early, late = Counter(), [], []
            for r in new:
                seen[r[3]] += 1
                (early if seen[r[3]] <= 3 else late).append(r)
            new = early + late
        want += [(q, i, round(-x, 4), True) for x, _, i, _ in (new[: m.most] if m.most else new)]
    frame = spark.createDataFrame(found, "query_id long, id long, path string, score double")
    out = A.reranked(frame, scored(spark, queries, rows, mode), spark.createDataFrame(rows, ROWS), "id", mode)
    got = sorted((r.query_id, r.id, round(r.score, 4), r.added) for r in out.collect())
    want.sort()
    assert [(*r[:2], r[3]) for r in got] == [(*r[:2], r[3]) for r in want] and all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(got, want, strict=True))
    assert any(r[3] for r in got) == (mode != "rerank_only")


def test_terms_of_words(spark):
    """A task cuts words as the columns do."""
    words = ["TestLedgerReplay", "a", "_", "./-", "x9y8Z7", "src/App-one.GO", "İstanbulÉcole", "ΣΑΣ", "éÉx", "a1B", "\\a\\B", "ǅx", "٣A"]
    got = {r.w: sorted(r.t) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", A.text_terms(F.col("w")).alias("t")).collect()}
    assert got == {w: sorted([A.word_terms(w)[0], *A.word_terms(w)]) for w in words}  # the text is its only token


@pytest.mark.parametrize("mode", ["v1", "code_task_family_v2"])
def test_texts_and_best(spark, mode, monkeypatch):
    """Terms found in texts score as listed ones, in rows that share a key, too; leaving out what cannot be best loses none."""
    queries, rows = data()
    rows = rows + [(90, "docs/b.md", "retries", "ledger replay model", None)]
    frame = spark.createDataFrame(rows, ROWS)
    names = F.when(F.col("test").isNotNull(), A.test_terms(F.col("test"))).otherwise(F.array().cast("array<string>"))
    texts = {"path": A.path_texts(F.col("path")), "title": F.array("title"), "body": F.array("body")}
    monkeypatch.setattr(A, "ROWS", 7)
    out = lambda most: [tuple(r) for r in A.scores(spark.createDataFrame(queries, QUERIES), frame, "id", {"test_name": names}, mode, texts, most).collect()]
    want = [tuple(r) for r in scored(spark, queries, rows, mode).collect()]
    every = out(None)
    assert sorted(map(str, every)) == sorted(map(str, want)) and len(want) > 100
    best = lambda rs: {(q, *r) for q, _ in queries for r in sorted(((-r[2], r[1]) for r in rs if r[0] == q))[:3]}
    assert best(out(3)) == best(every)


def test_no_pairs_are_shuffled(spark):
    """Only what a candidate holds is shuffled, once: pairs of queries and candidates stay beside their candidate."""
    queries, rows = data()
    plan = scored(spark, queries, rows, "v1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "hashpartitioning(key" in plan and "Window" not in plan


def of_test(rows):
    """Rows as candidates: names of tests as units, others with whole test files among them; some without id or path."""
    rng = random.Random(6)
    out = []
    for i, (key, path, title, body, test) in enumerate(rows * 4):
        unit = ("source_context", "test_case") if test else (None, None)
        path = f"{path}#L{i}" if test else rng.choice([path, path.replace(".go", "_test.go"), f"tests/{path.removesuffix('.md')}_test.py", f"docs/plans/{i}.md"])
        out.append((None if i % 40 == 39 else key + 100 * i, None if i % 50 == 49 else path, test or title, body, *unit))
    return out


@pytest.mark.parametrize("mode", ["v1", "code_task_family_v2", "rerank_only"])
def test_best_reranked(spark, mode):
    """Scores that meet beside their candidate give the best rows of all pairs, also where whole test files stay or go."""
    queries, rows = data()
    queries = [(q, f"{t or ''} {['tests for', 'source file', 'rules', ''][i % 4]}" if i % 5 else t) for i, (q, t) in enumerate(queries)]
    found = spark.createDataFrame(queries, QUERIES)
    naming = found.select("query_id", F.concat_ws(" ", "text", F.lit("webhook")).alias("text"))
    frame = spark.createDataFrame(of_test(rows), "id long, path string, title string, body string, kind string, subtype string").repartition(3)
    names = F.when(F.col("subtype") == "test_case", A.test_terms(F.col("title"))).otherwise(F.array().cast("array<string>"))
    texts = {"path": A.path_texts(F.col("path")), "title": F.array("title"), "body": F.array("body")}
    base = C.without_raw_tests(C.scored(found, frame, "id")).select("query_id", "id", "path", "score")
    every = C.top_rows(A.reranked(base, A.scores(naming, frame, "id", {"test_name": names}, mode, texts), frame, "id", mode), "id", 9)
    want = Counter((r.query_id, r.id, r.path, r.score, r.added, r["rank"]) for r in every.collect())
    best = A.best_reranked(found, naming, frame, "id", {"test_name": names}, texts, mode, 9)
    got = Counter((r.query_id, r.id, r.path, r.score, r.added, r["rank"]) for r in best.collect())
    assert got == want and sum(want.values()) > 60
    assert any(k[4] for k in want) == (mode != "rerank_only") and any("_test." in (k[2] or "") for k in want)


def test_pairs_meet_beside_their_candidate(spark, sf):
    """Base scores are judged once, and no pair of a query and a candidate is joined or shuffled."""
    plan = P.anchor_reranked(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "hashpartitioning(query_id" not in plan and "SortMergeJoin" not in plan


def test_best_reranked_of_few(spark):
    """No queries, no candidates, and rows that share an id: each is found once, with what anchors add."""
    rows = [(1, "docs/plans/ledger.md", "Ledger", "ledger replay"), (1, "docs/plans/replay.md", "Replay", "ledger"), (2, "pkg/ledger_test.go", "", "ledger"), (None, "docs/plans/a.md", "Ledger replay", ""), (3, "docs/x.md", "", None)]
    rows += [(100 + i, f"docs/other/{i}.md", "Other", "") for i in range(20)]
    queries, frame = spark.createDataFrame([(7, "ledger replay_log tests")], QUERIES), spark.createDataFrame(rows, "id long, path string, title string, body string")
    texts = {"path": A.path_texts(F.col("path")), "title": F.array("title"), "body": F.array("body")}
    best = lambda q, c: [tuple(r) for r in A.best_reranked(q, q, c, "id", {}, texts, "v1", 5).orderBy("rank").collect()]
    assert best(queries.limit(0), frame) == best(queries, frame.limit(0)) == []
    got = best(queries, frame)
    plain = {r.path: r.score for r in C.scored(queries, frame, "id").collect()}
    assert sorted(r[2] for r in got if not r[4]) == sorted(plain) and len(plain) >= 3
    more = {r[2]: round(r[3] - plain[r[2]], 6) for r in got if not r[4]}
    assert more["docs/plans/ledger.md"] == more["docs/plans/replay.md"] > 0 == more["docs/plans/a.md"]
