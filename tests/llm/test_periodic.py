"""Periodic runs against definitions in plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

import corpusloom.llm.periodic as m
from corpusloom.llm.periodic import collapsed, find_runs, lyndon, op11_periodic_runs, periodic_runs

from .fixtures import SF, documents, frame, odd, with_clashes


def plain_runs(w, length, exponent):
    """For each period the maximal stretches that keep it, with those removed that have a smaller one."""
    n, found = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and w[k] == w[k + q]:
                k += 1
            if k - i + q >= max(length, exponent * q):
                found.setdefault((i, k - i + q), q)
            i = k + 1
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_lyndon(w):
    n = len(w)
    after = [next((j for j in range(i + 1, n) if w[j:] < w[i:]), n) for i in range(n)]
    same = [next((k for k in range(n - j) if w[i + k] != w[j + k]), n - j) for i, j in enumerate(after)]
    return after, same


def strings():
    rng = random.Random(5)
    yield from ([], [1], [1] * 40, [1, 2] * 30, [2, 1] * 31 + [2], list(range(30)), list(range(30, 0, -1)))
    for k in (1, 2, 3, 4, 8):
        for _ in range(120):
            yield [rng.randrange(k) for _ in range(rng.randrange(1, 70))]
    for _ in range(150):  # runs with noise between and inside
        out = []
        for _ in range(rng.randrange(1, 5)):
            root = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            out += (root * 12)[: rng.randrange(3, 60)] + [rng.randrange(4) for _ in range(rng.randrange(3))]
        yield out
    a, b = [0], [0, 1]
    for _ in range(8):
        a, b = b, b + a
    yield b
    yield [bin(i).count("1") % 2 for i in range(128)]


def test_lyndon_arrays():
    for w in strings():
        for x in (w, [-c for c in w]):
            assert lyndon(x) == plain_lyndon(x), x


@pytest.mark.parametrize(("length", "exponent"), [(2, 2), (6, 2), (6, 3), (24, 3), (10, 4)])
def test_runs(length, exponent):
    n = 0
    for w in strings():
        words = [b"%d" % c for c in w]
        got = find_runs(words, length, exponent)
        assert got == plain_runs(words, length, exponent), w
        n += len(got)
    assert n > 20


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_comparisons_are_in_proportion_to_the_words(monkeypatch):
    """Successful comparisons, on texts that repeat in many ways."""
    looked = 0
    plain = m._agree

    def counted(w, k, d, end):
        nonlocal looked
        out = plain(w, k, d, end)
        looked += out - k
        return out

    monkeypatch.setattr(m, "_agree", counted)
    n, rng = 20_000, random.Random(1)
    root = [rng.randrange(50) for _ in range(700)]
    kinds = {
        "one word": [1] * n,
        "two words": [0, 1] * (n // 2),
        "rising blocks": [i % 100 for i in range(n)],
        "fibonacci": fibonacci(n),
        "thue-morse": [bin(i).count("1") % 2 for i in range(n)],
        "random": [rng.randrange(2) for _ in range(n)],
        "long period": (root * 30)[:n],
        "copies with changes": [c if rng.random() > 0.01 else 99 for c in (root * 30)[:n]],
        "powers of powers": (([0] * 20 + [1]) * 20 + [2]) * (n // 421),
    }
    for name, w in kinds.items():
        for x in (w, [-c for c in w]):
            looked = 0
            lyndon(x)
            assert looked <= len(x), (name, looked / len(x))


def test_collapsing():
    words = b"a b c d e f g h".split() * 5 + b"x y".split()
    runs = find_runs(words)
    assert runs == [(0, 40, 8)]
    assert collapsed(words, runs) == b"a b c d e f g h x y".split()
    assert collapsed(words[:20], find_runs(words[:20])) == words[:20]


def brute(docs):
    out = []
    for d, t in docs:
        w = (t or "").encode().split()
        n = len(w)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w, 24, 3) if n < 3000 else find_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        drop = {i for s, size, q in runs for i in range(s + q, s + size)}
        sha = lambda x: hashlib.sha256(x).hexdigest()
        more = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((d, len(runs), *more, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop))))
    return sorted(out, key=str)


def test_query_is_the_plain_one(spark):
    got = sorted(map(tuple, op11_periodic_runs(spark, SF).collect()), key=str)
    assert got == brute([r[:2] for r in documents()]) and sum(r[1] > 0 for r in got) >= 10


def test_odd_rows(spark, tmp_path):
    rows = [*odd(), *[(i, " ".join(f"u{j % (i + 1)}" for j in range(50 + i)), "en", "s", 1) for i in range(40)], (77, "same " * 50_000, "en", "s", 1), (78, " ".join(f"v{i % 9_000}" for i in range(40_000)), "en", "s", 1)]
    docs = with_clashes(frame(spark, rows), "runs best collapsed start length period n_runs")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == brute([r[:2] for r in rows])


def test_empty(spark):
    assert periodic_runs(frame(spark, [], parts=1)).count() == 0
    with pytest.raises(ValueError, match="exponent"):
        periodic_runs(frame(spark, [], parts=1), exponent=1)
