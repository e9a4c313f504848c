"""Periodic runs of words by the Ellert-Fischer method: Lyndon arrays, no suffix structures and no hashes.

The words of a text are an ordered alphabet (their byte order). For that order and for the reverse one, a scan from the
left keeps the chain of last smaller suffixes and finds for each place the next smaller suffix, whose distance is the
longest Lyndon word there, together with how far the two suffixes agree. Comparisons reuse extensions matched already:

- inside the match that reaches furthest to the right, two suffixes agree as their copies did, unless that leads to the
  match's end, where comparing goes on;
- going on from a candidate to the one it follows, the agreement is the smaller of the two known ones, and only if those
  are equal is it extended, from where they end.

So words are compared successfully only beyond the furthest match so far: at most one success a word and one failure a pair.

Each run has a Lyndon root in one of the two orders at a place where the next smaller suffix is one period away, so one
further scan reads off all maximal runs from the two arrays, extending to the left by less than a period. Places that
cannot reach the length asked for, and those inside a run already read off, are passed over.

Before that a text is cut at words that occur in it, or in their part of it, less often than a run's exponent: no run can
hold them. Ordinary prose falls apart, so the scans see the rest only; the result is the same.

Documents are independent: one narrow stage, no shuffle. A task holds one Arrow batch and the arrays of one text, in
proportion to its words. Texts are whole.

Nulls, ties and odd input: a null text has no words and no runs (empty collapsed text); runs that tie in exponent are told
by smaller start, then period; repeated rows each get a row; a null doc_id is kept; an empty table gives no rows; only
doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD, blank_if_null, bounded_batches, table

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Places compared one by one before stretches are compared, and the longest stretch.
SINGLE, STRETCH = 8, 4096
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _agree(w: list[int], k: int, d: int, end: int) -> int:
    """The first place from k on that differs from the one d later, or end."""
    stop = min(end, k + SINGLE)
    while k < stop:
        if w[k] != w[k + d]:
            return k
        k += 1
    step = SINGLE
    while k < end:
        step = min(step, end - k)
        if w[k : k + step] == w[k + d : k + d + step]:
            k += step
            step = min(2 * step, STRETCH)
        elif step <= SINGLE:
            while w[k] == w[k + d]:
                k += 1
            return k
        else:
            step //= 2
    return end


def lyndon(w: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next smaller suffix (n if none; a suffix is smaller than one it begins) and for how many words the
    two agree."""
    n = len(w)
    after, same = [n] * n, [0] * n
    before, back = [-1] * n, [0] * n  # the last smaller suffix to the left, and how far that one agrees
    first = reach = shift = 0  # the words from first to reach equal those shift places before, and no match goes further
    for r in range(1, n):
        a, l, e = w[r], r - 1, 0
        while l >= 0:
            if not e and w[l] != a:
                if w[l] < a:
                    break
                after[l], l = r, before[l]
                continue
            x = -1
            if r < reach and l >= first:  # the same two suffixes have been compared shift places before
                if after[l - shift] == r - shift:
                    x = same[l - shift]
                elif before[r - shift] == l - shift:
                    x = back[r - shift]
            if 0 <= x < reach - r:
                e = x
            else:
                e = _agree(w, l + (e if x < 0 else max(e, reach - r)), r - l, n - r + l) - l
                if r + e > reach:
                    first, reach, shift = r, r + e, r - l
            if r + e < n and w[l + e] < w[r + e]:
                break
            # r is smaller than l, and agrees with what l follows as far as both agree with l
            while True:
                after[l], same[l] = r, e
                known, l = back[l], before[l]
                if l < 0 or known <= e:
                    break
            if l >= 0 and known < e:  # l departs from both first, downwards
                e = known
                break
        before[r], back[r] = l, e if l >= 0 else 0
    return after, same


def _from_order(w: list[int], length: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    after, same = lyndon(w)
    n = len(w)
    done: dict[int, int] = {}
    for i in range(n):
        j, r = after[i], same[i]
        p = j - i
        if r + 2 * p - 1 < max(length, exponent * p) or done.get(p, 0) >= j:
            continue
        k = i
        while k > 0 and w[k - 1] == w[k - 1 + p]:
            k -= 1
        done[p] = j + r
        if j + r - k >= max(length, exponent * p):
            yield k, j + r - k, p


def _pieces(codes: np.ndarray, length: int, exponent: int) -> Iterator[tuple[int, int]]:
    """Parts (begin, end) of the text in which every word occurs often enough for a run."""
    parts = [(0, len(codes))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < length:
            continue
        _, at, times = np.unique(codes[lo:hi], return_inverse=True, return_counts=True)
        cut = np.flatnonzero(times[at] < exponent)
        if not len(cut):
            yield lo, hi
            continue
        ends = np.concatenate([[lo - 1], cut + lo, [hi]])
        parts += [(a, b) for a, b in zip((ends[:-1] + 1).tolist(), ends[1:].tolist(), strict=True) if b - a >= length]


def find_runs(words: list[bytes], length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least ``length`` words and ``exponent`` (2 or more) periods."""
    if len(words) < length:
        return []
    rank = {x: i for i, x in enumerate(sorted(set(words)))}
    codes = np.fromiter(map(rank.__getitem__, words), np.int64, len(words))
    found = set()
    for lo, hi in _pieces(codes, length, exponent):
        for w in (codes[lo:hi].tolist(), (-codes[lo:hi]).tolist()):
            found.update((lo + s, size, p) for s, size, p in _from_order(w, length, exponent))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, size, p in runs:
        keep[start + p : start + size] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def periodic_runs(docs: DataFrame, *, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period), best (the run of greatest exponent, null if none)
    and collapsed (text of the words left, joined by one space) for each row of docs."""
    if exponent < 2:
        raise ValueError("a run has an exponent of 2 at least")
    kind = docs.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, best, texts = [], [], []
            for t in b.column("text").to_pylist():
                words = t.split()
                found = find_runs(words, length, exponent)
                each = [{"start": s, "length": n, "period": p} for s, n, p in found]
                runs.append(each)
                best.append(max(each, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None))
                texts.append(b" ".join(collapsed(words, found)))
            cols = [b.column("doc_id").cast(arrow_kind), pa.array(runs, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "runs", "best", "collapsed"])

    one = "struct<start:long,length:long,period:long>"
    return docs.select("doc_id", F.encode(blank_if_null(), "UTF-8").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, runs array<{one}>, best {one}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where each tenth document (by a checksum of its id) repeats some of its words to its end."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def repeated(w: F.Column) -> F.Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(w, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))), " ")

    text = blank_if_null()
    # an array of one element, so that the words are found once
    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    planted = F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(text).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.expr("(1000 * best.length) div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE_SQL: dict[str, str] = {}  # compared with a brute-force version in tests/llm
