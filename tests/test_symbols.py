"""Symbol references and their caps against a loop."""

import random
import re

from corpusloom.operators import symbols as S


def compact(t):
    return "".join(x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t).lower()) if x)


def plain_references(texts, files):
    known = {}
    for source, path, symbols in files:
        for s in symbols:
            if len(compact(s)) >= 4 and compact(s) not in S.NO_SYMBOLS:
                known.setdefault(compact(s), {})[source] = path
    out = {}
    for ref, title, body in texts:
        for t in re.findall(S.TOKEN, f"{title or ''}\n{body or ''}"):
            t = re.sub(r"^[_.$]+|[_.$]+$", "", t)
            shaped = re.search(r"[_\-.$0-9]|[a-z0-9][A-Z]", t) or len(t) >= 12
            if 4 <= len(t) <= 96 and shaped and len(known.get(compact(t), {})) in (1, 2, 3, 4):
                for source, path in known[compact(t)].items():
                    if source != ref:
                        k = (ref, source, compact(t), path)
                        out[k] = min(out.get(k, t), t)
    return out


def data():
    rng = random.Random(5)
    names = [f"load{c}Ledger" for c in "ABCDEFGH"] + ["parse_value", "Helper", "config", "plainword", "averylongplainword", "x1", "retry.policy", "TestReplay2"]
    files = [(f"s{i:02d}", f"src/f{i}.go", rng.sample(names, rng.randrange(0, 5))) for i in range(24)]
    form = lambda n: rng.choice([n, n, compact(n), n.replace("Ledger", "_ledger"), f"_{n}."])
    texts = [(f"t{i:02d}", rng.choice([None, form(rng.choice(names))]), " and ".join(form(rng.choice(names)) for _ in range(rng.randrange(0, 12)))) for i in range(40)]
    return texts + [("s01", "", "loadALedger loadBLedger"), ("e", None, None)], files


def frames(spark, texts, files):
    return spark.createDataFrame(texts, "ref string, title string, body string"), spark.createDataFrame(files, "source string, path string, symbols array<string>")


def test_references(spark):
    texts, files = data()
    got = {(r.ref, r.source, r.name, r.path): r.form for r in S.references(*frames(spark, texts, files)).collect()}
    assert got == plain_references(texts, files) and len(got) > 30


def test_caps_are_filled_in_order(spark):
    texts, files = data()
    per_text, per_source, want = {}, {}, []
    for ref, source, name, path in sorted(plain_references(texts, files), key=lambda k: (k[0], k[2], k[3], k[1])):
        if per_text.get(ref, 0) < 3 and per_source.get(source, 0) < 4:
            per_text[ref], per_source[source] = per_text.get(ref, 0) + 1, per_source.get(source, 0) + 1
            want.append((ref, source, name, path))
    got = S.reference_edges(*frames(spark, texts, files), of_text=3, to_source=4, most=30).collect()
    assert [(r.ref, r.source, r.name, r.path) for r in got] == want[:30] and len(want) > 30
    assert {(r.weight, r.confidence) for r in got} == {(0.78, 0.82)}


def test_empty(spark):
    texts, files = frames(spark, [], [])
    assert S.reference_edges(texts, files).count() == 0
