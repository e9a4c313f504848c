"""Language ID by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary (all that are letters only, in lower case; every letter is a piece as well). Each language has a probability for each piece. The probability of a word is the sum over all ways to cut it into
pieces, by a forward pass; a text's is the product over its words. The pieces' probabilities are fitted by expectation
maximisation over the same lattice on a bounded sample of labelled rows: PER_LANGUAGE rows of each language on average,
drawn by a hash of doc_id from the rows that are not held out. Predictions use the text alone.

Nulls, ties and odd input: lang_pred is 'und' and the score 0 if the text is null or has no letter, or if nothing was
learned (no labelled rows); ties go to the first language by code point; repeated rows each get a row; an empty table gives
no rows; only doc_id, text and (for the fit) lang are read. Words of any length are scored whole (long ones in logarithms);
the fit reads words over LONGEST_WORD letters in stretches of that many. A null doc_id counts as held out.

The score is the probability of the language among all, from the words' mean evidence: log-probabilities are divided by the
root of the number of words, since words of one text are not independent and their plain sum is 0 or 1 for any long text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, mixed, released, table

VOCABULARY = "piece_bpe_32k.model"
#: Longer words go through the lattice in logarithms, as their probability could vanish.
LONGEST_WORD = 32
PER_LANGUAGE = 300
ROUNDS = 4
#: Words that the fit passes through the lattice together, which bounds its memory on the driver.
FIT_WORDS = 2_000
#: Every piece has been seen so often before, and a letter outside the vocabulary has this probability.
PRIOR, UNKNOWN = 0.02, 1e-7
MOST_KNOWN = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """All segmentations of words into pieces, for many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted(set(pieces) | {c for p in pieces for c in p})
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for p in self.pieces for c in p}))}

    @cached_property
    def numbers(self) -> np.ndarray:
        out = np.zeros(0x110000, np.int64)
        out[[ord(c) for c in self.letters]] = list(self.letters.values())
        return out

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, the pieces' sorted keys and their numbers (from 1)."""
        out = []
        for n in range(1, self.longest + 1):
            some = [i for i, p in enumerate(self.pieces) if len(p) == n]
            keys = self.keys(self.codes([self.pieces[i] for i in some]), n)[:, 0] if some else np.zeros(1, np.uint64)
            number = np.array([i + 1 for i in some] or [0], np.int32)
            order = np.argsort(keys)
            assert len(np.unique(keys)) == len(keys), "two pieces have one key"
            out.append((keys[order], number[order]))
        return out

    @staticmethod
    def keys(codes: np.ndarray, n: int) -> np.ndarray:
        """64-bit keys of all runs of n letters; 0 where one is outside the vocabulary."""
        m = codes.shape[1] - n + 1
        key, known = np.zeros((len(codes), m), np.uint64), np.ones((len(codes), m), bool)
        for j in range(n):
            part = codes[:, j : j + m]
            key = key * _BASE + part.astype(np.uint64)
            known &= part > 0
        return mixed(key) * known

    def codes(self, words: list[str]) -> np.ndarray:
        """Words of one length as a matrix of letter numbers, 0 for letters outside the vocabulary."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.numbers[points].reshape(len(words), -1)

    def ids(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(end, length): each word's piece number there, 0 for none; only where some word has one, and for single letters."""
        out = {}
        for n in range(1, min(self.longest, codes.shape[1]) + 1):
            keys, number = self.tables[n - 1]
            key = self.keys(codes, n)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found = number[at] * (keys[at] == key) * (key > 0)
            for i in range(found.shape[1]):
                if n == 1 or found[:, i].any():
                    out[i + n, n] = np.ascontiguousarray(found[:, i])
        return out

    @staticmethod
    def alone(p: np.ndarray) -> np.ndarray:
        """p for single letters: no piece has no probability, but any letter may stand alone."""
        out = p.copy()
        out[0] = UNKNOWN
        return out

    def forward(self, codes: np.ndarray, p: np.ndarray, ids: dict | None = None) -> list[np.ndarray]:
        """Sums over all segmentations of each prefix; p: (pieces + 1) x languages, row 0 is zero."""
        ids, alone = self.ids(codes) if ids is None else ids, self.alone(p)
        alpha = [np.ones((len(codes), p.shape[1]))]
        for end in range(1, codes.shape[1] + 1):
            a = alpha[end - 1] * alone[ids[end, 1]]
            for n in range(2, min(self.longest, end) + 1):
                if (end, n) in ids:
                    a += alpha[end - n] * p[ids[end, n]]
            alpha.append(a)
        return alpha

    def log_forward(self, word: str, p: np.ndarray) -> np.ndarray:
        """The logarithm of the sum over all segmentations of one word, however long; p as in ``forward``."""
        codes, most = self.codes([word]), self.longest
        found = np.zeros((codes.shape[1] + 1, most), np.int32)  # [end, length - 1]: piece number
        for n in range(1, min(most, codes.shape[1]) + 1):
            keys, number = self.tables[n - 1]
            key = self.keys(codes, n)[0]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found[n:, n - 1] = number[at] * (keys[at] == key) * (key > 0)
        with np.errstate(divide="ignore"):
            logs, alone = np.log(p), np.log(self.alone(p))
        last = np.full((most, p.shape[1]), -np.inf)  # the prefixes' logarithms, the latest first
        last[0] = 0
        for end in range(1, codes.shape[1] + 1):
            each = np.concatenate([alone[found[end, :1]], logs[found[end, 1:]]]) + last
            top = each.max(0)
            last = np.concatenate([(top + np.log(np.exp(each - top).sum(0)))[None], last[:-1]])
        return last[0]

    def expected(self, codes: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by forward and backward passes; p has one language."""
        ids, length, alone = self.ids(codes), codes.shape[1], self.alone(p)
        alpha = self.forward(codes, p, ids)
        beta = [np.zeros_like(alpha[0]) for _ in range(length)] + [np.ones_like(alpha[0])]
        out = np.zeros(len(p))
        for end in range(length, 0, -1):
            for n in range(1, min(self.longest, end) + 1):
                if (end, n) not in ids:
                    continue
                use = (alone if n == 1 else p)[ids[end, n]] * beta[end]
                beta[end - n] += use
                out += np.bincount(ids[end, n], (counts * (alpha[end - n] * use / alpha[length])[:, 0]), len(p))
        out[0] = 0
        return out


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def vocabulary(path: str | None = None) -> list[str]:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = (model.id_to_piece(i).lstrip("▁").lower() for i in range(model.get_piece_size()))
    return [p for p in pieces if p.isalpha()]


class Model:
    """Piece probabilities of each language, and the scores of words under them."""

    def __init__(self, lattice: Lattice, languages: list[str], p: np.ndarray):
        self.lattice, self.languages, self.p = lattice, languages, p

    @classmethod
    def fit(cls, counts: dict[str, dict[str, int]], pieces: list[str]) -> Model:
        """counts: words' frequencies by language."""
        lattice = Lattice(pieces)
        n = len(lattice.pieces)
        p = np.zeros((n + 1, len(counts)))
        for j, lang in enumerate(sorted(counts)):
            words: dict[str, int] = {}
            for w, c in counts[lang].items():
                for lo in range(0, len(w), LONGEST_WORD):
                    words[w[lo : lo + LONGEST_WORD]] = words.get(w[lo : lo + LONGEST_WORD], 0) + c
            names = list(words)
            parts = [some[lo : lo + FIT_WORDS] for some in _by_length(names).values() for lo in range(0, len(some), FIT_WORDS)]
            groups = [(lattice.codes([names[i] for i in some]), np.array([words[names[i]] for i in some], float)) for some in parts]
            own = np.full((n + 1, 1), 1 / n)
            own[0] = 0
            for _ in range(ROUNDS):
                seen = np.full(n + 1, PRIOR)
                seen[0] = 0
                for codes, c in groups:
                    seen += lattice.expected(codes, c, own)
                own = (seen / seen.sum())[:, None]
            p[:, j] = own[:, 0]
        return cls(lattice, sorted(counts), p)

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for length, some in _by_length(words).items():
            if length > LONGEST_WORD:
                for i in some:
                    out[i] = self.lattice.log_forward(words[i], self.p)
                continue
            for lo in range(0, len(some), 20_000):
                at = some[lo : lo + 20_000]
                out[at] = np.log(self.lattice.forward(self.lattice.codes([words[i] for i in at]), self.p)[-1])
        return out


class Scorer:
    """Scores texts; each distinct word goes through the lattice once while it is remembered."""

    def __init__(self, model: Model):
        self.model, self.known, self.logs = model, {}, np.zeros((0, len(model.languages)))

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        found = [w if any(c.isalpha() for x in w for c in x) else [] for w in found]
        known = self.known
        new = list({w for ws in found for w in ws if w not in known})
        if len(known) + len(new) > MOST_KNOWN:
            known.clear()
            new, self.logs = list({w for ws in found for w in ws}), self.logs[:0]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.logs = np.concatenate([self.logs, self.model.words(new)])
        lang, score = [], []
        for ws in found:
            if not ws or not self.model.languages:
                lang.append("und")
                score.append(0.0)
                continue
            total = self.logs[np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))].sum(0)
            best = int(total.argmax())
            lang.append(self.model.languages[best])
            score.append(float(1 / np.exp((total - total[best]) / np.sqrt(len(ws))).sum()))
        return lang, score


def held_out() -> F.Column:
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def fit_model(docs: DataFrame, per_language: int = PER_LANGUAGE, pieces: list[str] | None = None) -> Model:
    """Fit on about per_language labelled rows a language (whole texts), never on held-out rows."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return Model(Lattice(["a"]), [], np.zeros((2, 0)))
    u = F.xxhash64("doc_id", F.lit("fit")).bitwiseAND(F.lit(0x7FFFFFFF)) / F.lit(float(0x80000000))
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    words = rows.where(u < rate).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("lang", "word").count()
    counts: dict[str, dict[str, int]] = {}
    for r in words.collect():  # of a sample of bounded size
        counts.setdefault(r[0], {})[r[1]] = r[2]
    return Model.fit(counts, vocabulary() if pieces is None else pieces)


def identify(docs: DataFrame, model: Model, *, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (by default doc_id) with held_out, lang_pred and score, which replace columns of those names."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("held_out", "lang_pred", "score")]
    text = "text" if "text" in keep else "_text"
    bounded_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(share.value)
        for whole in batches:
            for lo in range(0, len(whole), 200):
                b = whole.slice(lo, 200)
                lang, score = scorer.scores(b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "held_out", "lang_pred", "score"])

    rows = docs.select(*keep, held_out().alias("held_out"), *([] if text in keep else [F.col("text").cast("string").alias(text)]))
    fields = [*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "held_out boolean, lang_pred string, score double"]
    return rows.mapInArrow(released(run), ", ".join(fields))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_model(docs))


QUERIES = {"op6_language_id": op6_language_id}
ORACLE_SQL: dict[str, str] = {}  # held-out accuracy and a brute-force lattice in tests/llm
