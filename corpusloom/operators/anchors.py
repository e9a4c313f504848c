"""Anchors of queries: the words that name what is asked for, scored by the fields that hold them.

An anchor is a quoted phrase, a path, a compact identifier or a rarer word; words for a kind of document count little and
words for a task not at all. Anchors are looked up by field in the row of a candidate (a task remembers the terms of a word);
what is shuffled are the anchors that a candidate holds, as numbers. Their weight is the inverse document frequency over all
fields but the body. What an anchor counts for is worked out once for the queries; pairs of queries and candidates are added
up beside the candidate. A mode is a table of weights.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import filled
from .candidates import _COMPACT_TEST, Best, _name_parts, asked, beside, spread

# Words for tasks, for kinds of documents, broad words, words that name no subject of their own in code tasks.
TASK_WORDS = ("a", "add", "an", "and", "are", "build", "change", "check", "continue", "cover", "covers", "covered", "context", "do", "fix", "for", "from", "generate", "get", "help", "how", "implement", "improve", "into", "make", "need", "next", "or", "run", "same", "share", "shared", "show", "so", "that", "the", "these", "this", "those", "to", "update", "use", "what", "when", "where", "which", "who", "why", "with", "without", "work", "working", "behavior", "behaviour")
ROLE_WORDS = ("adr", "adrs", "architecture", "decision", "design", "document", "documents", "plan", "plans", "prd", "prds", "proposal", "requirements", "requirement", "rfc", "rfcs", "skill", "skills", "spec", "template", "templates", "test", "tests")
BROAD_WORDS = ("api", "architecture", "config", "context", "design", "docs", "document", "integration", "mode", "requirements", "service", "spec", "system", "template", "test")
CODE_WORDS = ("add", "allow", "application", "applications", "change", "code", "context", "endpoint", "endpoints", "enforce", "file", "files", "fix", "handle", "implement", "model", "models", "route", "routes", "source", "support", "supports", "supported", "update", "use", "validate", "web")
SUPPORT_WORDS = ("action", "actions", "base", "common", "correctly", "exists", "handle", "handling", "multiple", "state", "states", "status", "statuses")
PROTOCOL_WORDS = ("agent", "agents", "boilerplate", "claude", "codex", "command", "commands", "convention", "conventions", "cursor", "governance", "instruction", "instructions", "maintainer", "maintainers", "policy", "policies", "procedure", "procedures", "prompt", "prompts", "protocol", "rule", "rules", "scaffold", "scaffolding", "skill", "skills", "standard", "standards", "template", "templates")
# Weight and most hits of a field, and weight of a field that is the quoted phrase.
FIELDS = {"path": (4.5, 2), "title": (4.0, 2), "test_name": (5.0, 2), "heading": (3.0, 3), "symbol": (2.5, 3)}
PHRASE_FIELDS = {"path": 4.5, "title": 4.0, "test_name": 5.0, "heading": 3.0}
MOST_ROLE_HITS, MOST_BODY_HITS, COMPACT_FACTOR, LONE_ROLE_FACTOR, MOST_BOOST = 2, 3, 1.25, 0.25, 24.0
PER_LEAD, LEAST_IDF = 3, 1.8
#: Words whose terms a task remembers.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 40
KINDS = ("phrase", "role", "path", "compact", "rare")


class Mode(NamedTuple):
    """Weights of the role and body fields and of a body that is the phrase; modifiers of kinds; what a further row needs."""

    role: float
    body: float
    phrase_body: float
    of_role: float
    of_broad: float
    compact: float
    path: float
    phrase: float
    rare: float
    code: bool
    least_score: float
    least_idf: float
    most: int


# Fixed values.
MODES = {
    "v1": Mode(1.2, 0.2, 0.45, 0.18, 0.08, 1.8, 1.35, 1.4, 1.05, False, 10.0, 0.0, 0),
    "strong_field": Mode(0.35, 0.0, 0.0, 0.08, 0.0, 1.8, 1.35, 1.4, 1.05, False, 12.0, 1.8, 1),
    "strict": Mode(0.0, 0.0, 0.0, 0.0, 0.0, 1.8, 1.35, 1.4, 0.45, False, 14.0, 1.8, 1),
    "code_task": Mode(0.05, 0.05, 0.08, 0.0, 0.0, 2.0, 1.5, 1.5, 1.2, True, 8.0, 1.25, 3),
    "code_task_family": Mode(0.05, 0.05, 0.08, 0.0, 0.0, 2.0, 1.5, 1.5, 1.2, True, 8.0, 1.25, 3),
    "code_task_family_v2": Mode(0.05, 0.05, 0.08, 0.0, 0.0, 2.0, 1.5, 1.5, 1.2, True, 10.0, 1.8, 8),
    "rerank_only": Mode(1.2, 0.2, 0.45, 0.18, 0.08, 1.8, 1.35, 1.4, 1.05, False, float("inf"), 0.0, 0),
    "selected_only": Mode(1.2, 0.2, 0.45, 0.18, 0.08, 1.8, 1.35, 1.4, 1.05, False, float("inf"), 0.0, 0),
}
LONE_ROLE = 0.05
_TOKEN = r"[\p{L}\p{Nd}_./\\\-]+"
_QUOTES = "^[`'\"]+|[`'\"]+$"


def _named(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), _QUOTES, "")


def _compact(t: Column) -> Column:
    return F.when(F.size(_name_parts(t)) > 0, F.array_join(_name_parts(t), "")).otherwise(_named(t))


def text_terms(c: Column) -> Column:
    """All terms of a text, with repeats: the text itself, its tokens, their parts and their compact forms."""
    each = F.transform(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)), lambda t: F.concat(F.array(_named(t)), _name_parts(t), F.array(_compact(t))))
    return F.filter(F.concat(F.array(_named(c)), F.flatten(each)), lambda t: t != "")


def path_texts(c: Column) -> Column:
    """A path, its name without ending, and each of its segments without ending."""
    bare = lambda s: F.regexp_replace(s, r"\.[^.]*$", "")
    segments = F.split(c, "/")
    return F.concat(F.array(c, bare(F.element_at(segments, -1))), F.transform(segments, bare))


def path_terms(c: Column) -> Column:
    """Terms of a path, of its name without ending, and of each of its segments without ending."""
    return F.flatten(F.transform(path_texts(c), text_terms))


def test_terms(name: Column) -> Column:
    """Terms of a test's name: its compact form with and without a leading test, and its parts."""
    short = F.array_join(_name_parts(name), "")
    return F.filter(F.concat(F.array(short, F.regexp_replace(short, "^test(?=.)", "")), _name_parts(name)), lambda t: t != "")


def query_anchors(queries: DataFrame) -> DataFrame:
    """query_id, ord, term, kind, specific (whether the query has a specific anchor) and protocol (whether it is about rules
    and instructions) for queries (query_id, text); words for tasks are no anchors."""
    text = filled("text")
    quoted = F.regexp_extract_all(text, F.lit(r"""(?s)"[^"]*"|'[^']*'"""), F.lit(0))
    one = lambda kind, term: F.struct(F.lit(kind).alias("kind"), _named(term).alias("term"))
    none = F.array().cast("array<struct<kind:string,term:string>>")

    def of(t: Column) -> Column:
        low, short = F.lower(t), _compact(t)
        digit, mixed = t.rlike(r"\p{Nd}"), t.rlike(r"\p{Ll}") & t.rlike(r"\p{Lu}")
        identifier = ((F.octet_length(t) >= 8) & (mixed | digit)) | ((F.octet_length(low) >= 9) & low.rlike(_COMPACT_TEST))
        long, broad = F.octet_length(low) >= 4, low.isin(*BROAD_WORDS)
        return (
            F.when(low.isin(*TASK_WORDS), none)
            .when(low.isin(*ROLE_WORDS), F.array(one("role", low)))
            .when(t.rlike(r"[/\\_.\-]"), F.when((short != "") & (short != low), F.array(one("path", low), one("compact", short))).otherwise(F.array(one("path", low))))
            .when(identifier, F.when(long & ~broad, F.array(one("compact", short), one("rare", low))).otherwise(F.array(one("compact", short))))
            .when(broad, F.array(one("role", low)))
            .when(long, F.array(one("rare", low)))
            .otherwise(none)
        )

    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    found = F.concat(F.transform(quoted, lambda x: one("phrase", F.trim(F.regexp_replace(x, "^.|.$", "")))), F.flatten(F.transform(tokens, of)))
    df = queries.select("query_id", F.array_distinct(F.filter(found, lambda a: a["term"] != "")).alias("a"))
    df = df.withColumn("specific", F.exists("a", lambda a: a["kind"] != "role"))
    df = df.withColumn("protocol", F.exists("a", lambda a: a["term"].isin(*PROTOCOL_WORDS)))
    return df.select("query_id", "specific", "protocol", F.posexplode("a").alias("ord", "x")).select("query_id", "ord", "x.term", "x.kind", "specific", "protocol")


def alternates(term: Column) -> Column:
    """Singular forms of a term."""
    n = F.octet_length(term)
    cut = lambda k: F.expr(f"left(term, length(term) - {k})")
    return F.when(n < 5, F.lit(None)).when(term.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y"))).when(term.rlike("(sses|ses|xes|zes|ches|shes)$"), cut(2)).when(term.rlike("[^s]s$"), cut(1))


def word_terms(word: str) -> list[str]:
    """Terms of one token, as text_terms has them."""
    if word.isascii() and word.isalpha() and word[1:].islower():
        return [word.lower()] * 3
    if word.isascii():
        spaced = re.sub("([a-z0-9])([A-Z])", r"\1 \2", word)
    else:
        kinds = [unicodedata.category(c) for c in word]
        spaced = "".join(" " + c if i and kinds[i] == "Lu" and kinds[i - 1] in ("Ll", "Nd") else c for i, c in enumerate(word))
    # a token has no other characters between its parts; one letter alone becomes a letter and a mark (U+0307)
    low, parts = word.lower(), [x for x in re.split("[ _./\\\\\u0307-]+", spaced.lower()) if x]
    return [low, *parts, "".join(parts) or low]


class Lookup:
    """Places of the wanted terms among terms and in words."""

    def __init__(self, wanted: list[str]) -> None:
        self.place = {t: i for i, t in enumerate(wanted)}
        self.known: dict[str, tuple[int, ...]] = {}

    def of_term(self, term: str) -> tuple[int, ...]:
        return (self.place[term],) if term in self.place else ()

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            found = tuple(self.place[t] for t in word_terms(word) if t in self.place)
            if len(word) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found


def expanded(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run of so many."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def looked_up(lists: pa.ListArray, of: Callable[[str], tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each wanted term in lists of strings."""
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    some = flat.is_valid().to_numpy(zero_copy_only=False)
    coded = flat.drop_null().dictionary_encode()
    each = [of(w) for w in coded.dictionary.to_pylist()]
    size = np.array([len(x) for x in each], np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    at = expanded((np.cumsum(size) - size)[codes], size[codes])
    return np.repeat(row[some], size[codes]), np.array([i for x in each for i in x], np.int64)[at]


def held(candidates: DataFrame, key: str, fields: dict[str, Column], texts: dict[str, Column], wanted: list[str]) -> DataFrame:
    """key and found: the wanted terms that a candidate holds, as array<struct<at, n>>: at is the place of the term times the
    number of fields, plus that of the field. fields: arrays of terms by name; texts: arrays of texts whose terms are found."""
    fields_, longest = len(fields) + len(texts), max(map(len, wanted), default=0)
    tokens = lambda t: F.flatten(F.transform(F.filter(t, lambda x: x.isNotNull()), lambda x: F.regexp_extract_all(x, F.lit(_TOKEN), F.lit(0))))
    # a text is a term itself, too; of long ones none is wanted, and without quotes they are known by their length
    able = lambda x: (F.length(F.trim(x)) <= longest) | x.contains("`") | x.contains("'") | x.contains('"')
    wholes = lambda t: F.filter(F.transform(F.filter(t, able), _named), lambda x: F.length(x) <= longest)
    columns = [(i, False, c) for i, c in enumerate(fields.values())]
    for i, t in enumerate(texts.values(), len(fields)):
        columns += [(i, True, tokens(t)), (i, False, wholes(t))]
    rows = spread(candidates).select(F.col(key).alias("key"), *[c.alias(f"c{n}") for n, (_, _, c) in enumerate(columns)])
    sources = [(i, in_words) for i, in_words, _ in columns]
    shared = candidates.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, most = Lookup(shared.value), max(1, len(shared.value)) * fields_
        for whole in batches:
            for lo in range(0, whole.num_rows, MATCHED):
                b = whole.slice(lo, MATCHED)
                cells = []
                for n, (i, in_words) in enumerate(sources, 1):
                    row, term = looked_up(b.column(n), lookup.of_word if in_words else lookup.of_term)
                    cells.append(row * most + term * fields_ + i)
                cell, count = np.unique(np.concatenate(cells), return_counts=True)
                ends = np.searchsorted(cell, np.arange(b.num_rows + 1) * most).astype(np.int32)
                found = pa.StructArray.from_arrays([pa.array((cell % most).astype(np.int32)), pa.array(count.astype(np.int32))], ["at", "n"])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), found)], ["key", "found"])

    of_key = candidates.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {of_key}, found array<struct<at:int,n:int>>").where(F.size("found") > 0)


def vocabulary(held_terms: DataFrame, n: Column) -> DataFrame:
    """term, df and idf of terms that candidates hold (key, term); short words and words for tasks have none."""
    known = ((F.octet_length("term") >= 3) | F.col("term").isin(*ROLE_WORDS)) & ~F.col("term").isin(*TASK_WORDS)
    df = held_terms.where(known).groupBy("term").agg(F.count_distinct("key").alias("df"))
    return df.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


class Pairs(NamedTuple):
    """Rows and queries that an anchor scores: what boosts and admits judge, and the uses of anchors from start on."""

    row: np.ndarray
    query: np.ndarray
    score: np.ndarray
    max_idf: np.ndarray
    strong: np.ndarray
    fields: np.ndarray  # bits by place of the field
    kinds: np.ndarray  # bits by place in KINDS
    lead: np.ndarray  # a use, -1: none
    use: np.ndarray
    start: np.ndarray
    size: np.ndarray


class Scorer:
    """Adds up what the anchors of queries count for in candidates. uses: one row an anchor of a query; most: rows that
    cannot be among the best so many of their query are left out (None: all are returned)."""

    def __init__(self, uses: list[Row], wanted: list[str], names: list[str], alternate: dict[str, str], mode: Mode, most: int | None) -> None:
        place = {t: i for i, t in enumerate(wanted)}
        queries = dict.fromkeys(u.query_id for u in uses)
        uses = sorted(uses, key=lambda u: place[u.term])
        number = {q: i for i, q in enumerate(queries)}
        self.fields, self.terms, self.most = len(names), max(1, len(wanted)), most
        self.ids = list(queries)
        self.first = np.searchsorted([place[u.term] for u in uses], np.arange(len(wanted) + 1))
        column = lambda f, kind: np.array([f(u) for u in uses], kind)
        self.query, self.ord, self.factor, self.idf = column(lambda u: number[u.query_id], np.int64), column(lambda u: u.ord, np.int64), column(lambda u: u.factor, float), column(lambda u: u.idf, float)
        self.subject, self.strong, self.lead = column(lambda u: u.kind != "role", bool), column(lambda u: u.strong, bool), column(lambda u: u.lead, bool)
        self.term, self.kind = pa.array([u.term for u in uses], pa.string()), pa.array([u.kind for u in uses], pa.string())
        self.kind_bit = column(lambda u: 1 << KINDS.index(u.kind), np.int64)
        weights = {**FIELDS, "role": (mode.role, MOST_ROLE_HITS), "body": (mode.body, MOST_BODY_HITS)}
        self.weight, self.cap = np.array([weights.get(n, (0.0, 0))[0] for n in names]), np.array([weights.get(n, (0.0, 0))[1] for n in names])
        self.of_phrase = np.array([{**PHRASE_FIELDS, "body": mode.phrase_body}.get(n, 0.0) for n in names])
        self.phrase = np.array([" " in t for t in wanted], bool)
        self.telling = sum(1 << i for i, n in enumerate(names) if n in ("path", "title", "test_name"))
        self.named = pa.array([sorted(n for i, n in enumerate(names) if mask >> i & 1) for mask in range(1 << len(names))], pa.list_(pa.string()))
        # terms by their alternates: where a field has none of a term, its alternate counts
        by = sorted((place[a], place[t]) for t, a in alternate.items())
        self.alternates = np.array([t for _, t in by], np.int64)
        self.of_alternate = np.searchsorted([a for a, _ in by], np.arange(len(wanted) + 1))
        self.best = np.full((len(self.ids), most or 0), -np.inf)

    def hits(self, row: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, term, weighted count and fields (bits) of what the rows hold."""
        size = self.terms * self.fields
        cell, same = np.unique(row * size + at, return_inverse=True)
        n = np.bincount(same, n, len(cell))
        if len(self.alternates):
            term = cell % size // self.fields
            k = self.of_alternate[term + 1] - self.of_alternate[term]
            more = np.repeat(cell, k) + (self.alternates[expanded(self.of_alternate[term], k)] - np.repeat(term, k)) * self.fields
            new = ~np.isin(more, cell)
            cell, n = np.concatenate([cell, more[new]]), np.concatenate([n, np.repeat(n, k)[new]])
            order = np.argsort(cell, kind="stable")
            cell, n = cell[order], n[order]
        term, field = cell % size // self.fields, cell % self.fields
        tf = np.where(self.phrase[term], n * self.of_phrase[field], np.minimum(n, self.cap[field]) * self.weight[field])
        kept = ~self.phrase[term] | (tf > 0)
        pair, start = np.unique(cell[kept] // self.fields, return_index=True)
        if not len(pair):
            return pair, pair, np.zeros(0), pair
        tf, mask = np.add.reduceat(tf[kept], start), np.bitwise_or.reduceat(np.int64(1) << field[kept], start)
        ok = tf > 0
        return pair[ok] // self.terms, pair[ok] % self.terms, tf[ok], mask[ok]

    def promising(self, query: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Whether a row can be among the best of its query; scores so far are remembered."""
        order = np.lexsort((-score, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        top = order[rank < self.most]
        for q in np.unique(query[top]):
            both = np.concatenate([self.best[q], score[top[query[top] == q]]])
            self.best[q] = np.partition(both, len(both) - self.most)[-self.most :]
        return score >= self.best.min(1)[query] - 2e-6  # scores are rounded to six digits later

    def pairs(self, lists: pa.ListArray) -> Pairs:
        """What the anchors of each query count for in each row of found terms (array<struct<at, n>>)."""
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        row, term, tf, mask = self.hits(row, *(flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n")))
        k = self.first[term + 1] - self.first[term]
        use, each = expanded(self.first[term], k), np.repeat(np.arange(len(term)), k)
        worth = tf[each] * self.factor[use]
        use, each, worth = use[worth > 0], each[worth > 0], worth[worth > 0]
        cell = row[each] * len(self.ids) + self.query[use]
        order = np.lexsort((self.ord[use], cell))
        cell, use, worth, mask = cell[order], use[order], worth[order], mask[each][order]
        pair, start = np.unique(cell, return_index=True)
        if not len(pair):
            return Pairs(pair, pair, np.zeros(0), np.zeros(0), np.zeros(0, bool), pair, pair, pair, pair, pair, pair)
        size = np.diff(np.append(start, len(cell)))
        place, beyond = np.arange(len(cell)), len(cell)
        first = lambda ok: np.minimum.reduceat(np.where(ok, place, beyond), start)
        # a word for a kind of document counts less before any subject
        alone = ~self.subject[use] & (place <= np.repeat(first(self.subject[use]), size))
        score = np.add.reduceat(np.where(alone, worth * LONE_ROLE_FACTOR, worth), start)
        lead = first(self.lead[use])
        strong = np.logical_or.reduceat(self.strong[use] & (mask & self.telling > 0), start)
        fields, kinds, idf = np.bitwise_or.reduceat(mask, start), np.bitwise_or.reduceat(self.kind_bit[use], start), np.maximum.reduceat(self.idf[use], start)
        lead = np.where(lead < beyond, use[np.minimum(lead, beyond - 1)], -1)
        return Pairs(pair // len(self.ids), pair % len(self.ids), score, idf, strong, fields, kinds, lead, use, start, size)

    def scored(self, keys: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        p = self.pairs(lists)
        kept = np.flatnonzero(self.promising(p.query, p.score)) if self.most and len(p.query) else np.arange(len(p.query))
        members = p.use[expanded(p.start[kept], p.size[kept])]
        ends = pa.array(np.append(0, np.cumsum(p.size[kept])).astype(np.int32))
        lead = p.lead[kept]
        leads = self.term.take(pa.array(np.maximum(lead, 0), mask=lead < 0))
        columns = {
            "query": pa.array(p.query[kept].astype(np.int32)), "key": keys.take(pa.array(p.row[kept])), "score": pa.array(p.score[kept]), "terms": pa.ListArray.from_arrays(ends, self.term.take(pa.array(members))),
            "kinds": pa.ListArray.from_arrays(ends, self.kind.take(pa.array(members))), "fields": self.named.take(pa.array(p.fields[kept])), "strong": pa.array(p.strong[kept]), "max_idf": pa.array(p.max_idf[kept]), "lead": leads,
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


#: Rows of candidates whose terms are looked up together, and that are scored together.
MATCHED, ROWS = 2000, 200


def weighed(queries: DataFrame, candidates: DataFrame, key: str, fields: dict[str, Column], mode: str, texts: dict[str, Column]) -> tuple[list[Row], list[str], list[str], dict[str, str], Mode]:
    """What a Scorer is made of for queries and the vocabulary of candidates: uses, wanted terms, names of the fields, alternates,
    mode."""
    m = MODES[mode]
    spark = candidates.sparkSession
    anchors = query_anchors(queries).where("specific")
    alt = anchors.select("term", (alternates(F.col("term")) if m.code else F.lit(None).cast("string")).alias("alt")).distinct()
    alternate = {r.term: r.alt for r in alt.collect()}
    wanted = sorted({*alternate, *alternate.values()} - {None})
    alternate = {t: a for t, a in alternate.items() if a is not None}
    no_body = lambda of: {n: c for n, c in of.items() if n != "body"}
    named, n_named = held(candidates, key, no_body(fields), no_body(texts), wanted), len(no_body(fields)) + len(no_body(texts))
    numbers = named.select("key", F.explode(F.array_distinct(F.transform("found", lambda x: F.floor(x["at"] / n_named).cast("int")))).alias("no"))
    listed = spark.createDataFrame(list(enumerate(wanted)), "no int, term string")
    vocab = vocabulary(numbers.join(F.broadcast(listed), "no"), F.lit(candidates.count()))
    if m.code:
        # the rarer of a term and its singular tells the weight; the terms are a stated set
        vocab = spark.createDataFrame(vocab.select("term", "df", "idf").collect(), "term string, df long, idf double")
        other = alt.where("alt IS NOT NULL").join(vocab.select(F.col("term").alias("alt"), F.col("df").alias("df2"), F.col("idf").alias("idf2")), "alt")
        both = vocab.join(other.select("term", "df2", "idf2"), "term", "full_outer")
        rarer = F.col("df").isNull() | (F.col("idf2") > F.col("idf"))
        vocab = both.select("term", F.when(rarer, F.coalesce("df2", "df")).otherwise(F.col("df")).alias("df"), F.when(rarer, F.coalesce("idf2", "idf")).otherwise(F.col("idf")).alias("idf"))
    kind, term, idf = F.col("kind"), F.col("term"), F.coalesce("idf", F.lit(1.0))
    broad = term.isin(*BROAD_WORDS)
    rare = F.when(term.isin(*CODE_WORDS), 0.0).otherwise(m.rare) if m.code else F.lit(m.rare)
    modifier = F.when(kind == "role", F.when(broad, m.of_broad).otherwise(m.of_role)).when(kind == "compact", m.compact).when(kind == "path", m.path).when(kind == "phrase", m.phrase).otherwise(rare)
    weight = F.when(kind == "compact", F.greatest(idf - 1, F.lit(1.0))).otherwise(F.greatest(idf - 1, F.lit(0.0)))
    factor = F.when(kind == "compact", COMPACT_FACTOR).otherwise(1.0) * weight * modifier
    common = F.col("df").isNotNull() & (idf < LEAST_IDF) & (kind != "compact")
    strong = (kind != "role") & ~broad & ~common & (F.lit(mode != "strict") | (kind != "rare"))
    lead = (kind != "role") & ~term.isin(*SUPPORT_WORDS, *CODE_WORDS)
    uses = anchors.join(vocab, "term", "left").select("query_id", "ord", "term", "kind", "protocol", factor.alias("factor"), idf.alias("idf"), strong.alias("strong"), lead.alias("lead")).collect()
    return uses, wanted, [*fields, *texts], alternate, m


def scores(queries: DataFrame, candidates: DataFrame, key: str, fields: dict[str, Column], mode: str = "v1", texts: dict[str, Column] | None = None, most: int | None = None) -> DataFrame:
    """query_id, key, score, matches and kinds (in the order of the query), fields, strong, max_idf, lead (the first subject
    among the matches), protocol for each query with a specific anchor and candidate that an anchor scores. fields: arrays of
    terms by name; texts: arrays of texts by name, whose terms are found without listing them (far less work for long texts).
    most: rows that cannot be among the best so many of their query may be left out. The queries are a stated set, whose
    anchors go to all tasks."""
    texts = texts or {}
    uses, wanted, names, alternate, m = weighed(queries, candidates, key, fields, mode, texts)
    spark = candidates.sparkSession
    shared = spark.sparkContext.broadcast((uses, wanted, names, alternate, m, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                yield scorer.scored(b.column(0).slice(lo, ROWS), b.column(1).slice(lo, ROWS))

    # rows that share a key are one candidate
    rows = held(candidates, key, fields, texts, wanted).groupBy("key").agg(F.flatten(F.collect_list("found")).alias("found"))
    of_key = candidates.schema[key].dataType.simpleString()
    out = rows.mapInArrow(run, f"query int, key {of_key}, score double, terms array<string>, kinds array<string>, fields array<string>, strong boolean, max_idf double, lead string")
    of_query = {u.query_id: u.protocol for u in uses}
    asking = spark.createDataFrame([(i, q, p) for i, (q, p) in enumerate(of_query.items())], f"query int, query_id {queries.schema['query_id'].dataType.simpleString()}, protocol boolean")
    return out.join(F.broadcast(asking), "query").select("query_id", F.col("key").alias(key), F.round("score", 6).alias("score"), F.array_distinct("terms").alias("matches"), F.array_distinct("kinds").alias("kinds"), "fields", "strong", "max_idf", "lead", "protocol")


def is_instruction(path: Column) -> Column:
    """Files of rules and instructions, which only queries about such files are to find."""
    p = F.lower(path)
    return F.element_at(F.split(p, "/"), -1).isin("agents.md", "claude.md", "codeowners", "governance.md", "maintainers.md", "skill.md") | p.endswith(".agent.md") | p.rlike(r"/\.claude/|/\.codex/skills/|/\.cursor/rules/|/\.github/issue_template/")


class Columns:
    """What boosts and admits judge, in rows."""

    def __init__(self) -> None:
        self.score, self.max_idf, self.strong, self.led = F.col("score"), F.col("max_idf"), F.col("strong"), F.col("lead").isNotNull()

    def into(self, *fields: str) -> Column:
        return F.arrays_overlap("fields", F.array(*map(F.lit, fields)))

    def of(self, *kinds: str) -> Column:
        return F.arrays_overlap("kinds", F.array(*map(F.lit, kinds)))


class Arrays:
    """What boosts and admits judge, in pairs of a task."""

    def __init__(self, pairs: Pairs, names: list[str]) -> None:
        self.score, self.max_idf, self.strong, self.led = np.round(pairs.score, 6), pairs.max_idf, pairs.strong, pairs.lead >= 0
        self.pairs, self.names = pairs, names

    def into(self, *fields: str) -> np.ndarray:
        return self.pairs.fields & sum(1 << i for i, n in enumerate(self.names) if n in fields) > 0

    def of(self, *kinds: str) -> np.ndarray:
        return self.pairs.kinds & sum(1 << KINDS.index(k) for k in kinds) > 0


def boosts(mode: str, of: Columns | Arrays) -> Column | np.ndarray:
    """Whether a score adds to a row that is found already."""
    exact = of.of("compact", "path", "phrase")
    if MODES[mode].code:
        rest = (of.score >= 4.0) & (of.max_idf >= 1.25) & of.into("path", "title", "symbol", "heading") & of.of("compact", "path", "phrase", "rare")
    else:
        rest = of.into("path", "title", "test_name") & exact
        if mode == "v1":
            rest = rest | (exact & (of.max_idf >= LEAST_IDF) & of.into("heading", "symbol"))
    able = (of.score >= 1.0) & (of.strong | rest)
    return able & of.led if mode == "code_task_family_v2" else able


def admits(mode: str, of: Columns | Arrays) -> Column | np.ndarray:
    """Whether a score adds a row that is not found yet."""
    m = MODES[mode]
    able = of.strong & (of.score >= m.least_score) & (of.max_idf >= m.least_idf)
    if mode == "v1":
        return able
    if mode == "strong_field":
        return able & of.into("path", "title", "test_name")
    if mode == "strict":
        return able & of.into("path", "title", "test_name") & of.of("compact", "path", "phrase")
    if mode == "code_task_family_v2":
        return able & of.into("path", "title", "symbol", "heading", "test_name") & of.led
    return able & of.into("path", "title", "symbol", "heading")


def reranked(found: DataFrame, scored: DataFrame, paths: DataFrame, key: str, mode: str = "v1") -> DataFrame:
    """query_id, key, path, score, added of found (query_id, key, path, score) after anchors: scores of scored (of the same
    mode) are added where they may, and rows that are not found are added by score and path, as many as the mode takes (0:
    all). In the mode code_task_family_v2 each lead adds PER_LEAD rows before any adds more."""
    m = MODES[mode]
    able = scored.join(paths.select(key, F.col("path").alias("_path")), key).where(~is_instruction(F.col("_path")) | F.col("protocol"))
    delta = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(MOST_BOOST))
    more = able.where(boosts(mode, Columns())).select("query_id", key, delta.alias("_more"))
    first = found.join(more, ["query_id", key], "left").select("query_id", key, "path", F.round(F.col("score") + F.coalesce("_more", F.lit(0.0)), 6).alias("score"), F.lit(False).alias("added"))
    known = found.select("query_id").distinct()
    new = able.where(admits(mode, Columns())).join(known, "query_id", "left_semi").join(found.select("query_id", key), ["query_id", key], "left_anti")
    new = new.select("query_id", key, F.col("_path").alias("path"), F.round(delta, 6).alias("score"), F.lit(True).alias("added"), "lead")
    order = [F.desc("score"), F.col("path"), F.col(key)]
    if mode == "code_task_family_v2":
        of_lead = F.row_number().over(Window.partitionBy("query_id", "lead").orderBy(*order))
        new = new.withColumn("_later", (F.col("lead").isNull() | (of_lead > PER_LEAD)).cast("int"))
        order = [F.col("_later"), *order]
    if m.most:
        new = new.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_rank") <= m.most)
    return first.unionByName(new.select(*first.columns))


class Reranker:
    """The best rows of each query beside their candidates: of found rows with what anchors add, and of rows that anchors add.
    Whole test files are kept apart, as they stay or go by units of tests of other tasks."""

    def __init__(self, scorer: Scorer, names: list[str], mode: str, of_number: np.ndarray, of_scorer: np.ndarray, protocol: np.ndarray, most: int) -> None:
        self.scorer, self.names, self.mode, self.m = scorer, names, mode, MODES[mode]
        self.of_number, self.of_scorer, self.protocol = of_number, of_scorer, protocol
        self.by_lead = mode == "code_task_family_v2"
        n = len(protocol)
        self.found = [Best(n, most), Best(n, most)]
        self.most_new = self.m.most or most
        self.new: dict[tuple[int, str | None, bool], list[tuple]] = {}
        self.units = np.zeros(n, bool)

    def show(self, keys: list, terms: pa.ListArray, rows: pa.ListArray) -> None:
        """keys, the terms they hold and their candidates (beside), each one row a key."""
        n, queries = len(keys), len(self.protocol)
        of_key = np.repeat(np.arange(n), pc.list_value_length(rows).to_numpy(zero_copy_only=False))
        each = rows.flatten()
        no, score, stays = (each.field(c) for c in ("no", "score", "stays"))
        of_row = np.repeat(np.arange(len(each)), pc.list_value_length(no).to_numpy(zero_copy_only=False))
        query = self.of_number[no.flatten().to_numpy(zero_copy_only=False)]
        score, stays = score.flatten().to_numpy(zero_copy_only=False), stays.flatten().to_numpy(zero_copy_only=False).astype(bool)
        paths, of_rules = each.field("path").to_pylist(), each.field("of_rules").to_numpy(zero_copy_only=False)
        unit = each.field("unit").to_numpy(zero_copy_only=False).astype(bool)
        self.units[query[unit[of_row]]] = True
        cell = of_key[of_row] * queries + query

        pairs = self.scorer.pairs(terms)
        at = self.of_scorer[pairs.query]
        some = (at >= 0) & np.array([k is not None for k in keys], bool)[pairs.row]
        judged = Arrays(pairs, self.names)
        delta = np.clip(judged.score, 0.0, MOST_BOOST)
        scored = pairs.row * queries + at
        # a file of rules is scored for queries about such files only
        plain = np.zeros(n, bool)
        plain[of_key[of_rules == 0]] = True
        more = np.zeros(n * queries)
        boosted = some & boosts(self.mode, judged) & (plain[pairs.row] | self.protocol[at])
        more[scored[boosted]] = delta[boosted]
        total = np.round(score + more[cell], 6)
        ties = [(k is not None, k) for k in keys]
        tied = [ties[i] for i in of_key]
        for best, of in ((self.found[0], stays), (self.found[1], ~stays)):
            place = np.flatnonzero(of)
            if len(place):
                # rows of a key and query are few, but may be several
                self._found(best, place, query, of_row, total, tied, keys, of_key, paths)
        held = [np.zeros(n * queries, bool), np.zeros(n * queries, bool)]
        held[0][cell[stays]] = held[1][cell[~stays]] = True
        new = np.flatnonzero(some & admits(self.mode, judged))
        new = new[~held[0][scored[new]]]
        begins = np.searchsorted(of_key, np.arange(n + 1))
        for i in new.tolist():
            k, q, lead = int(pairs.row[i]), int(at[i]), int(pairs.lead[i])
            lead_term = self.scorer.term[lead].as_py() if lead >= 0 else None
            group = self.new.setdefault((q, lead_term if self.by_lead else None, bool(held[1][scored[i]])), [])
            for j in range(begins[k], begins[k + 1]):
                if of_rules[j] and not self.protocol[q]:
                    continue
                path = None if of_rules[j] == 2 else paths[j]
                worth = float(np.round(delta[i], 6))
                item = (-worth, *((path or "", ties[k]) if self.m.most else (ties[k],)))
                if len(group) < self.most_new or item < group[-1][0]:
                    bisect.insort(group, (item, (keys[k], path, worth, lead_term)), key=lambda x: x[0])
                    del group[self.most_new :]

    def _found(self, best: Best, place: np.ndarray, query: np.ndarray, of_row: np.ndarray, total: np.ndarray, tied: list, keys: list, of_key: np.ndarray, paths: list[str]) -> None:
        """Shows rows by candidate and query, a candidate in several layers if it meets a query several times."""
        order = place[np.lexsort((query[place], of_row[place]))]
        cell = of_row[order] * len(self.protocol) + query[order]
        layer = np.arange(len(cell)) - np.searchsorted(cell, cell)
        for n in range(int(layer.max()) + 1):
            at = order[layer == n]
            score = np.full((len(tied), len(self.protocol)), -np.inf)
            score[of_row[at], query[at]] = total[at]
            best.show(score, tied, lambda r, q: (keys[of_key[r]], paths[r], float(score[r, q]), None))  # noqa: B023

    def rows(self) -> list[tuple]:
        """query, key, path, score, lead, added, sure of all that is kept; units of tests as rows without score."""
        out = [(q, *x[2], False, i == 0) for i, best in enumerate(self.found) for q, rows in enumerate(best.rows) for x in rows]
        out += [(q, *x[1], True, not may_go) for (q, _, may_go), group in self.new.items() for x in group]
        return out + [(int(q), None, None, None, None, False, True) for q in np.flatnonzero(self.units)]


def best_reranked(queries: DataFrame, naming: DataFrame, candidates: DataFrame, key: str, fields: dict[str, Column], texts: dict[str, Column], mode: str, most: int) -> DataFrame:
    """query_id, key, path, score, added and rank: the best rows of each query by score and key of what reranked gives for its
    base score without raw tests (queries) and anchor scores (naming, texts of the same query_ids). Both scores meet beside the
    candidate: what is shuffled is what a candidate holds and which queries admit it, and the best rows of each task. Both
    queries are stated sets, which go to all tasks. Rows that share a key are one candidate for anchors."""
    spark = candidates.sparkSession
    asking = asked(queries)
    uses, wanted, names, alternate, m = weighed(naming, candidates, key, fields, mode, texts)
    ids = list(dict.fromkeys(r.query_id for r in asking))
    place = {q: i for i, q in enumerate(ids)}
    of_number = np.array([place[r.query_id] for r in asking], np.int64)
    of_scorer = np.array([place.get(q, -1) if q is not None else -1 for q in dict.fromkeys(u.query_id for u in uses)], np.int64)
    protocol = np.zeros(len(ids) + 1, bool)  # the last one stands for no query
    for u in uses:
        if u.query_id in place:
            protocol[place[u.query_id]] = u.protocol
    shared = spark.sparkContext.broadcast((uses, wanted, names, alternate, m, of_number, of_scorer, protocol))

    path = F.col("path")
    of_rules = F.when(path.isNull(), 2).when(is_instruction(path), 1).otherwise(0)
    found = beside(asking, candidates.withColumn("of_rules", of_rules), key, ("of_rules",))
    row = F.struct("path", "of_rules", "unit", "no", "score", "stays")
    # candidates without key are no candidates for anchors, and not one group
    alone = F.when(F.col(key).isNull(), F.xxhash64("path"))
    base = found.select(F.col(key).alias("key"), alone.alias("alone"), row.alias("row"))
    terms = held(candidates, key, fields, texts, wanted).where("key IS NOT NULL")
    both = base.withColumn("found", F.lit(None).cast(terms.schema["found"].dataType)).unionByName(terms.select("key", F.lit(None).cast("long").alias("alone"), F.lit(None).cast(base.schema["row"].dataType).alias("row"), "found"))
    grouped = both.groupBy("key", "alone").agg(F.flatten(F.collect_list("found")).alias("found"), F.collect_list("row").alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, wanted, names, alternate, m, of_number, of_scorer, protocol = shared.value
        reranker = Reranker(Scorer(uses, wanted, names, alternate, m, None), names, mode, of_number, of_scorer, protocol, most)
        kind = None
        for b in batches:
            kind = b.column(0).type
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                reranker.show(part.column(0).to_pylist(), part.column(1), part.column(2))
        rows = reranker.rows()
        if rows:
            kinds = (pa.int32(), kind, pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["query", "key", "path", "score", "lead", "added", "sure"])

    of_key = candidates.schema[key].dataType.simpleString()
    out = grouped.select("key", "found", "rows").mapInArrow(run, f"query int, key {of_key}, path string, score double, lead string, added boolean, sure boolean")
    of_query = Window.partitionBy("query")
    out = out.withColumn("_units", F.max(F.col("score").isNull()).over(of_query)).where("score IS NOT NULL")
    out = out.where(F.col("sure") | (F.col("added") == F.col("_units")))
    out = out.withColumn("_known", F.max(~F.col("added")).over(of_query)).where("NOT added OR _known")
    order = [F.desc("score"), F.col("path"), F.col("key")]
    if mode == "code_task_family_v2":
        of_lead = F.row_number().over(Window.partitionBy("query", "added", "lead").orderBy(*order))
        out = out.withColumn("_later", (F.col("lead").isNull() | (of_lead > PER_LEAD)).cast("int"))
        order = [F.col("_later"), *order]
    if m.most:
        out = out.withColumn("_rank", F.row_number().over(Window.partitionBy("query", "added").orderBy(*order))).where(~F.col("added") | (F.col("_rank") <= m.most))
    listed = spark.createDataFrame(list(enumerate(ids)), f"query int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    best = out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)
    return best.join(F.broadcast(listed), "query").select("query_id", F.col("key").alias(key), "path", "score", "added", "rank")
