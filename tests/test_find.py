"""The base score of candidates on small cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.operators import candidates as C
from corpusloom.operators.terms import Trie, bytes_of, cuts
from corpusloom.plans import find

QUERIES = "query_id long, text string"
CANDIDATES = "id long, path string, title string, body string, kind string, subtype string, status string, mode string"


def answer(spark, text, rows, ranked=True):
    """Paths of the answer, best first, by (path, body) or (path, body, other columns)."""
    rows = [(i, r[0], *(r[2].get(c) if len(r) > 2 else None for c in ("title",)), r[1], *(r[2].get(c) if len(r) > 2 else None for c in ("kind", "subtype", "status", "mode"))) for i, r in enumerate(rows)]
    found = C.without_raw_tests(C.scored(spark.createDataFrame([(1, text)], QUERIES), spark.createDataFrame(rows, CANDIDATES), "id"))
    return [r.path for r in C.ranked(found).orderBy("rank").collect()] if ranked else {r.path: r for r in found.collect()}


def profile(spark, text):
    return C.query_profiles(spark.createDataFrame([(1, text)], QUERIES)).first()


def test_terms_and_their_weights(spark):
    p = profile(spark, "Find the design for webhook_replay retries, the webhook_replay test")
    weights = {x.term: x.weight for x in p.terms}
    assert weights["webhook_replay"] == 1.0 and weights["design"] == 0.35 and weights["test"] == 0.25
    assert weights["replay"] == 0.35  # a part of an identifier
    assert weights["webhook"] == 1.2 and weights["stripe_event_id"] == 2.0  # by subject
    assert "find" not in weights and "the" not in weights
    assert list(p.ids) == ["webhook_replay"] and "design" not in p.core and "retries" in p.core


def test_phrases_stand_for_short_names(spark):
    assert {x.term: x.weight for x in profile(spark, "product requirements document for billing").terms}["prd"] == 2.5
    assert {x.term: x.weight for x in profile(spark, "an architecture decision record").terms}["adr"] == 2.5
    assert {x.term: x.weight for x in profile(spark, "rollout plan for auth").terms}["plan"] == 1.4


@pytest.mark.parametrize(("text", "most"), [("golden", 8), ("golden_path", 6), ("resume the work", 7), ("resume the_work", 6), ("source file", 5), ("design document", 6), ("why so", 5), ("RFC", 5), ("implement it", 6), ("follow the guidelines", 5)])
def test_rows_of_an_answer(spark, text, most):
    assert profile(spark, text).most == most


def test_title_alone_admits(spark):
    assert answer(spark, "Golden", [("plan.md", "Short body.", {"title": "Golden Plan"})]) == ["plan.md"]


def test_source_files_that_hold_all_identifiers_come_first(spark):
    rows = [
        ("svc/src/auth/session.ts", "type S = { customer_id?: string; authorization_details?: unknown }"),
        ("svc/src/billing/entitlements.ts", "const authorization_details = await load(customer_id)"),
        ("svc/src/billing/prices.ts", "const customer_id = 1"),
        ("docs/prd/entitlements.md", "`authorization_details` and `customer_id` for access checks."),
        ("docs/plans/ops-runbook.md", "customer_id authorization_details source file billing replay customer customer customer."),
    ]
    got = answer(spark, "authorization_details customer_id source file", rows)
    assert set(got) == {"svc/src/auth/session.ts", "svc/src/billing/entitlements.ts"}


def test_rfc_needs_the_subject(spark):
    rows = [
        ("docs/rfcs/0008-webhook-replay-protection.md", "Summary Motivation Alternatives stripe_event_id webhook_replay_protection replay ledger."),
        ("docs/rfcs/0009-search-ranking.md", "Summary Motivation Alternatives support search customer portal."),
        ("scratch/old-webhook-retry.md", "old retry notes for replay."),
    ]
    got = answer(spark, "RFC for webhook replay protection alternatives", rows)
    assert got[0] == "docs/rfcs/0008-webhook-replay-protection.md" and "scratch/old-webhook-retry.md" not in got


def test_plans_need_core_evidence(spark):
    rows = [("docs/plans/entitlement-sync.md", "Progress for entitlement_sync hardening and billing-webhook-hardening."), ("docs/plans/generic.md", "Current progress and next steps, without the words asked for.")]
    assert answer(spark, "resume entitlement sync hardening", rows) == ["docs/plans/entitlement-sync.md"]


def test_instructions_only_where_asked_for(spark):
    rows = [("docs/plans/auth-token-rollout.md", "Progress for auth token rollout.", {"title": "Auth Token Rollout Plan"}), ("CLAUDE.md", "Auth token rollout rules and instructions.", {"subtype": "agent_instruction", "mode": "protocol"})]
    assert answer(spark, "resume auth token rollout", rows) == ["docs/plans/auth-token-rollout.md"]
    assert "CLAUDE.md" in answer(spark, "claude instructions auth token rollout", rows)


def test_instructions_of_the_whole_repository(spark):
    rows = [(p, "Development guidance for all.", {"subtype": "agent_instruction", "title": f"{t} Instructions", "mode": "protocol"}) for p, t in (("CLAUDE.md", "Repository"), ("service/CLAUDE.md", "Service"))]
    assert answer(spark, "Claude repository instructions and development guidance", rows) == ["CLAUDE.md"]


def test_stale_decisions_for_lifecycle_queries(spark):
    rows = [
        ("docs/adr/0003-superseded-local-entitlements.md", "The local entitlement caching plan was abandoned.", {"status": "superseded"}),
        ("docs/plans/active-rollout.md", "Mentions local entitlement caching as old context but tracks current rollout.", {"status": "active"}),
    ]
    assert answer(spark, "continue local entitlement caching plan", rows) == ["docs/adr/0003-superseded-local-entitlements.md"]


def test_product_background(spark):
    rows = [
        ("docs/prd/billing-entitlements-v1.md", "Product requirements for billing entitlements and customer access."),
        ("docs/prd/customer-portal-v2.md", "Product background for customer portal billing access and entitlements."),
        ("docs/adr/0001-billing-source.md", "The authoritative billing source. customer_id joins entitlement records and access checks.", {"status": "accepted"}),
        ("docs/adr/0004-admin-billing-overrides.md", "Admin billing overrides mention customer access, authoritative.", {"status": "accepted"}),
        ("svc/src/billing/entitlements.ts", "customer access billing entitlements"),
        ("docs/plans/customer-access-notes.md", "customer access support notes"),
    ]
    got = answer(spark, "product background for billing entitlements and customer access", rows)
    assert set(got) == {"docs/prd/billing-entitlements-v1.md", "docs/adr/0001-billing-source.md"}


def test_tests_by_parts_of_their_names(spark):
    case = {"kind": "source_context", "subtype": "test_case"}
    rows = [(f"internal/tool_test.go#L{n}", f"Test: {name}\n", {"title": name, **case}) for n, name in ((42, "TestPutAndGetExposedTool"), (90, "TestPutHiddenTool"))]
    assert answer(spark, "what tests cover put and get exposed tool behavior?", rows)[0] == "internal/tool_test.go#L42"
    one = answer(spark, "testputandgetexposedtool", rows, ranked=False)
    assert one["internal/tool_test.go#L42"].found_identifiers == 1 and "internal/tool_test.go#L90" not in one
    assert answer(spark, "roadmap for the exposed tool", rows) == []


def test_units_of_tests_before_whole_test_files(spark):
    rows = [("pkg/ledger_test.go#L5", "Test: TestLedgerReplay", {"title": "TestLedgerReplay", "kind": "source_context", "subtype": "test_case"}), ("pkg/ledger_test.go", "func TestLedgerReplay ledger replay tests")]
    assert answer(spark, "tests for ledger replay", rows) == ["pkg/ledger_test.go#L5"]
    assert "pkg/ledger_test.go" in answer(spark, "tests for ledger replay in ledger_test", rows)
    assert answer(spark, "ledger replay roadmap", rows[1:]) == []


def test_nothing_is_rescued_and_ties_go_by_path(spark):
    assert answer(spark, "oauth provider session handoff", [("docs/prd/billing.md", "Product requirements for billing.", {"kind": "requirements"})]) == []
    assert answer(spark, "ledger", [(p, "ledger ledger", {"title": "Ledger"}) for p in ("docs/plans/b.md", "docs/plans/a.md")]) == ["docs/plans/a.md", "docs/plans/b.md"]


def test_nulls_blocks_of_queries_and_empty_tables(spark):
    queries = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "ledger", "ledger", "golden ledger"])], QUERIES)
    rows = spark.createDataFrame([(1, "docs/plans/a.md", None, None, None, None, None, None), (2, "docs/plans/ledger.md", "Ledger", "ledger", None, None, None, None), (3, None, None, "ledger", None, None, None, None)], CANDIDATES)
    one, many = ({tuple(r) for r in C.scored(queries, rows, "id", block=b).collect()} for b in (256, 2))
    assert one == many and {r[0] for r in one} == {2, 3, 4} and {r[1] for r in one} == {2}
    assert C.scored(queries, rows.limit(0), "id").count() == 0
    assert C.scored(queries.limit(0), rows, "id").count() == 0


def test_terms_are_found_inside_words(spark):
    rng = random.Random(3)
    terms = ["aba", "abab", "b_a", "local b", "ünd", "a.b", "bbb", "aaa"]
    row = type("R", (), {"no": 0, "terms": terms, "weights": [1.0] * len(terms), "core": terms[:3], "ids": []})
    finder = C.Finder(C.terms_of([row]))
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", "ab", "_", ".", " ", "local", "ünd", "\n", "-", "/"], k=40))
        assert finder.of_text(text) == {finder.terms[t]: text.count(t) for t in terms if t in text}


def test_rules_on_arrays_as_in_sql(spark):
    """Points of random pairs on arrays, a group of equal facts at a time, as Spark's SQL gives them."""
    rng = random.Random(5)
    numbers = {"core_terms": 6, "identifiers": 4, "cores": 4, "named": 4, "found_identifiers": 4}
    truths = [*C._ASKED, "identifier_term", "subject", "surface", "context_surface", *(f for f in C.KEPT if f not in ("role", "lane", "most_hits", "most_identifier_hits"))]
    roles = ["", "adr", "prd", "rfc", "plan", "agent_note", "design", "test_case", "code_comment", "agent_instruction", "protocol", "skill", "template", "model", "openspec_bundle", "openspec_design", "openspec_tasks", "openspec_spec", "openspec_proposal"]
    rows = []
    for i in range(600):
        facts = {f: rng.random() < 0.3 for f in truths} | {f: rng.randrange(n) for f, n in numbers.items()}
        rows.append({"i": i, **facts, "role": roles[i % len(roles)], "lane": rng.choice(["", "protocol", "model", "template", "trace"]), "test_name": rng.choice([0.0, 3.5, 10.0])})
    got = spark.createDataFrame(rows).selectExpr("i", f"CASE WHEN {C.never()} THEN NULL ELSE round({C.points()}, 6) END AS n").orderBy("i").collect()
    points = C.Points(C.RULES, C.NEVER)
    plain = [f for f in C.KEPT if f in rows[0]]
    for r, row in zip(got, rows, strict=True):
        values = {f: v if f in plain else np.array([[v]]) for f, v in row.items()}
        n = round(float(np.max(points.of(values))), 6)
        assert n == (r.n if r.n is not None else -np.inf), row
    assert sum(r.n is not None for r in got) > 100


def test_best_of_many_batches():
    rng = np.random.default_rng(4)
    score = rng.integers(0, 12, (400, 5)).astype(float)
    score[score < 3] = -np.inf
    best = C.Best(5, 6)
    for lo in range(0, 400, 30):
        best.show(score[lo : lo + 30], [f"p{i * 7 % 400}" for i in range(lo, min(lo + 30, 400))], lambda r, q, lo=lo: (lo + r, q))
    for q in range(5):
        want = sorted((-score[i, q], f"p{i * 7 % 400}", (i, q)) for i in range(400) if score[i, q] > 0)[:6]
        assert best.rows[q] == want


def test_only_the_best_leave_a_task(spark):
    """Rows that cannot be in an answer are left out beside their candidate; the answers are those from all pairs."""
    rng = random.Random(8)
    words = ["ledger", "replay", "webhook_id", "session", "retry", "portal"]
    shapes = [("docs/plans/{}.md", None, None), ("pkg/{}_test.go", None, None), ("pkg/{}_test.go#L5", "source_context", "test_case"), ("docs/prd/{}.md", None, None), ("svc/{}.ts", None, None)]
    rows = []
    for i in range(240):
        path, kind, subtype = rng.choice(shapes[:2] + shapes[3:] if i < 120 else shapes)
        rows.append((i, path.format(f"{rng.choice(words)}_{i}"), rng.choice(words), " ".join(rng.choices(words, k=6)), kind, subtype, None, None))
    texts = ["tests for ledger replay", "source file webhook_id session", "portal retry", "plan for ledger", "test of pkg/ledger_3_test.go retry_1_test.go", "tests for nothing"]
    queries, frame = spark.createDataFrame(list(enumerate(texts)), QUERIES), spark.createDataFrame(rows, CANDIDATES).repartition(3)
    every, best = C.scored(queries, frame, "id", block=4), C.scored(queries, frame, "id", block=4, most=3)
    answers = [sorted(tuple(r) for r in C.ranked(C.without_raw_tests(x)).where("rank <= 3").collect()) for x in (every, best)]
    assert answers[0] == answers[1] and len(answers[0]) >= 12
    assert best.count() < every.count() / 2
    assert {r.query_id for r in best.where("role = 'test_case'").collect()} == {r.query_id for r in every.where("role = 'test_case'").collect()}


def test_find_scored_judges_pairs_once(spark, sf):
    plan = find.find_scored(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_terms_do_not_reach_over_texts():
    """Occurrences in many texts at once, sliced and empty ones among them, as Python counts them in each."""
    rng = random.Random(12)
    terms = ["aba", "abab", "ünd", "a.b", "bbb", "ab a", "abcabcabc"]
    trie = Trie(terms)
    texts = ["".join(rng.choices(["a", "b", "ab", "abc", ".", " ", "ü", "nd", ""], k=rng.randrange(25))) for _ in range(500)]
    for array in (pa.array(["x", *texts, "y"]).slice(1, 500), pa.array(texts, pa.large_string())):
        row, term = trie.found(*bytes_of(array))
        got = np.bincount(row * len(terms) + term, minlength=500 * len(terms)).reshape(500, -1)
        assert got.tolist() == [[t.count(x) for x in terms] for t in texts] and got.any(0).all()
    assert cuts(bytes_of(pa.array(["aa", "", "bbbbbb", "c", "c"]))[1], 2, 3) == [(0, 2), (2, 3), (3, 5)]
