"""Secret spans against Python's regular expressions and a dictionary of owners."""

import hashlib
import re
from collections import defaultdict

from corpusloom.llm.secrets import scan_secrets

from .fixtures import documents, frame, odd, with_clashes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
KINDS = ("assign", "access", "hex", "owned")


def base_spans(t):
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def brute(rows, most=2):
    found, owners = [], defaultdict(set)
    for d, t, _, source, *_ in rows:
        base = sorted(base_spans(t or ""))
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", t or "")]
        more = [m for m in more if all(re.search(p, m[3]) for p in ("[a-z]", "[A-Z]", "[0-9]")) and not any(b[0] < m[2] and m[0] < b[2] for b in base)]
        for s in base + more:
            owners[s[3]].add(source)
        found.append((d, base, more))
    out = []
    for d, base, more in found:
        n = [sum(b[1] == k for b in base) for k in range(3)]
        text = lambda spans: ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e, _ in spans)
        spans = text(sorted(base + [m for m in more if len(owners[m[3]]) <= most]))
        out.append((d, *n, hashlib.sha256(text(base).encode()).hexdigest(), spans))
    return out


def run(df):
    return [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in scan_secrets(df).collect()]


def planted():
    key = "AKIA" + "Q7" * 9
    one, many = "sk_Live9aZ" + "xY7" * 8, "Ex4mpleKey" + "aB3" * 8
    texts = [f'é😀 password = "abcdef" Token:xyz api_key: {key} {"0a" * 14}', "APIKEY='short' secret=12345 passwd : ok_long-enough==", f"x {one} y", *[f"copied {many} {i}" for i in range(5)], "password=password=secret1 tokentoken=abcdef", "AKIAAKIA" + "A" * 30 + " " + "f" * 23 + " g" + "f" * 24, "ſecret=abcdef toKen=abcdefg"]
    return [(800 + i, t, "en", f"src{i}", 1) for i, t in enumerate(texts)]


def test_against_regular_expressions(spark):
    rows = documents() + planted() + odd()
    assert sorted(run(frame(spark, rows)), key=str) == sorted(brute(rows), key=str)


def test_owner_specific_and_copied_values(spark):
    got = {r.doc_id: r for r in scan_secrets(frame(spark, planted())).collect()}
    assert got[802].n_owned == 1 and "owned" in got[802].spans
    assert all(got[i].n_owned == 0 for i in range(803, 808))


def test_clashing_columns_and_empty(spark):
    df = with_clashes(frame(spark, planted()), "_row _owner _repo _text a k h t base more value start")
    assert sorted(run(df), key=str) == sorted(brute(planted()), key=str)
    assert run(frame(spark, [], parts=1)) == []


def test_value_copied_many_times_within_one_source(spark):
    copied, few = "C0piedKey" + "zX4" * 8, "F3wTimes" + "qW5" * 8
    rows = [(i, f"a {copied} and secret={copied[::-1]}", "en", "hot", 1) for i in range(101)]
    rows += [(200 + i, f"a {few}", "en", "hot", 1) for i in range(100)] + [(200, f"a {few}", "en", "hot", 1)]  # a doubled row counts once
    for r in scan_secrets(frame(spark, rows)).collect():
        assert (r.n_owned, r.n_example, r.n_live) == ((0, 1, 0) if r.doc_id < 200 else (1, 0, 0))
        assert ("owned" in r.spans) == (r.doc_id >= 200) and ("assign" in r.spans) == (r.doc_id < 200)


def test_time_is_in_proportion_to_the_matches(spark):
    """16 times the matches take far less than 256 times the seconds, and the spans stay right."""
    import time

    took = []
    for n in (6_000, 96_000):
        text = " ".join(f"token={i:06d}" for i in range(n))
        df = frame(spark, [(1, text, "en", "s", 1)], parts=1)
        run(df)
        began = time.time()
        (got,) = run(df)
        took.append(time.time() - began)
        assert got[1] == n and got[5].startswith("assign:0:12,assign:13:25") and got[5].endswith(f"assign:{13 * n - 13}:{13 * n - 1}")
    assert took[1] < 60 * took[0]


def test_time_is_in_proportion_to_base_spans_and_tokens_together(spark):
    import time

    took = []
    for n in (2_000, 32_000):
        text = " ".join(f"token={i:06d} Aa{i:06d}bbbbbbbbbbbbbbbb" for i in range(n))
        df = frame(spark, [(1, text, "en", "s", 1)], parts=1)
        run(df)
        began = time.time()
        (got,) = run(df)
        took.append(time.time() - began)
        assert got[1] == n and got[5].count("owned") == n
    assert took[1] < 60 * took[0]


def test_tokens_outside_base_spans(spark):
    import random

    from pyspark.sql import functions as F

    from corpusloom.llm.secrets import _outside

    rng = random.Random(6)
    span = "struct<start:int,kind:int,end:int,value:string>"
    rows = []
    for i in range(200):
        base = sorted((s, 0, s + rng.randrange(1, 30), "b") for s in rng.sample(range(900), rng.randrange(0, 200 if i % 3 else 4)))
        tokens, at = [], 0
        while (at := at + rng.randrange(0, 12)) < 900 and rng.random() < 0.99:
            tokens.append((at, 3, at + rng.randrange(1, 6), f"t{at}"))
            at = tokens[-1][2]
        rows.append((i, base, tokens))
    got = spark.createDataFrame(rows, f"id int, base array<{span}>, t array<{span}>").select("id", _outside(F.col("t"), F.col("base")).alias("free")).collect()
    want = {i: [x for x in t if not any(b[0] < x[2] and x[0] < b[2] for b in base)] for i, base, t in rows}
    assert {r.id: [tuple(x) for x in r.free] for r in got} == want
