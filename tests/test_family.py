"""Primary rows by families against a loop over stages."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import family as P

ROWS = "query_id long, id long, path string, title string, subtype string, rank int, reasons string, class string, family string, score double"


def plain_primary(rows, protect):
    most = 8 if protect else 6
    families = {}
    for r in rows:
        families.setdefault(r[8], []).append(r)
    for f in families.values():
        f.sort(key=lambda r: (-r[9], r[5], r[2]))
    order = sorted(families, key=lambda f: (-families[f][0][9], f))
    chosen = []

    def add(r):
        if r is not None and len(chosen) < most and r[1] not in chosen:
            chosen.append(r[1])

    if protect:
        safe = [r for r in rows if r[7] in ("source", "test") and "/examples/" not in r[2] and (1 <= r[5] <= 2 or r[9] >= 10 or "same_stem_source_recovery" in (r[6] or "") or "scout_anchor_admission" in (r[6] or ""))]
        for r in sorted(safe, key=lambda r: ("scout_anchor_admission" not in (r[6] or ""), r[5], -r[9], r[2]))[:4]:
            add(r)
    for f in order[:4]:
        for c in ("source", "test"):
            add(next((r for r in families[f] if r[7] == c), None))
    for f in order:
        for r in families[f]:
            if r[9] >= 7:
                add(r)
    for f in order:
        for r in families[f]:
            if len(chosen) < min(most, 4):
                add(r)
    return set(chosen)


@pytest.mark.parametrize("protect", [False, True])
def test_random_packs(spark, protect):
    rng = random.Random(3)
    rows, n = [], 0
    for q in range(60):
        for rank in rng.sample(range(1, 40), rng.randrange(1, 18)):
            n += 1
            reason = rng.choice([None, None, "", "same_stem_source_recovery", "x scout_anchor_admission y"])
            rows.append((q, n, f"a/{rng.choice(['examples/', ''])}p{n}", "t", "", rank, reason, rng.choice(["source", "test", "other"]), f"f{rng.randrange(6)}", float(rng.randrange(0, 12))))
    got = {(r.query_id, r.id) for r in P.primary(spark.createDataFrame(rows, ROWS), "id", protect).where("primary").collect()}
    assert got == {(q, i) for q in range(60) for i in plain_primary([r for r in rows if r[0] == q], protect)}


def test_families_classes_and_scores(spark):
    pack = [
        (1, 1, "src/billing/ledger.go", "Ledger", "", 1), (1, 2, "src/billing/tests/ledger_test.go", "x", "", 2), (1, 3, "src/billing/util.go", "", "", 3), (1, 4, "README.md", "The ledger", "", 4),
        (1, 5, "web/app/deep/down/cart.spec.ts#L4", "", "test_case", 5), (1, 6, "x.py", None, None, 30),
    ]
    df = spark.createDataFrame(pack, "query_id long, id long, path string, title string, subtype string, rank int").withColumn("reasons", F.lit(None).cast("string"))
    queries = spark.createDataFrame([(1, "fix ledger replay in billing_service of the web-app")], "query_id long, text string")
    got = {r.id: (r["class"], r.family, r.score) for r in P.pack_rows(df, queries).collect()}
    assert got[1][:2] == ("source", "stem:ledger") and got[2][:2] == ("test", "stem:ledger")
    assert got[1][2] == round(8 + 3 + 2.38, 6) and got[2][2] == round(8 + 3 + 2.26 + 0.5, 6)
    assert got[3] == ("source", "src/billing/util", round(3 + 2.14, 6)) and got[4] == ("other", "other:readme", round(2.5 + 2.02, 6))
    assert got[5][:2] == ("test", "app/deep/down/cart") and got[6] == ("source", "source:x", 0.0)
    rare = {r.id: r.score for r in P.pack_rows(df, queries, by_rarity=True).collect()}
    # ledger is in three rows (1.6), billing in three (1.6)
    assert rare[1] == round(8 * 1.6 + 4.5 * 1.6 + 2.7, 6) and rare[6] == 0.0


def test_empty(spark):
    assert P.primary(spark.createDataFrame([], ROWS), "id").count() == 0
