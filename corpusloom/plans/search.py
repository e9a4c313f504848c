"""Search: postings, BM25, lanes, fallback, vocabulary statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, identifier_parts, ngrams, normalized, occurrences, query_terms, token_estimate, tokens
from ..operators import positions as P
from ..operators import search as S
from ..sources import tables as T

# Tokens of a text in DuckDB, as functions.text.tokens has them.
TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
MOST = 20
#: Documents whose hits one task counts and scores, about.
DOCS = 1_000


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text, dealt to tasks by doc_id before tokens and queries multiply the rows: a document, its lines and their
    scores then stay in one task. As in the SQL, a document without doc_id counts in the corpus (which is of the whole table) only."""
    docs = T.table(spark, sf, "documents")
    tasks = max(-(-docs.count() // DOCS), spark.sparkContext.defaultParallelism)  # from the ends of the files
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").repartition(tasks, "doc_id")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, term: the search terms of each benchmark item: three bytes and more, no stop words."""
    wanted = F.filter(F.array_distinct(tokens("text")), lambda t: (F.octet_length(t) >= 3) & ~t.isin(*STOP_WORDS))
    return T.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(wanted).alias("term"))


_Q = f"q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter({TOKENS.format('text')}, lambda t: strlen(t) >= 3 AND t NOT IN {STOP_WORDS})) AS term FROM benchmark)"


def _post_sql(rel: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""tok AS (SELECT {key}, unnest({TOKENS.format(text)}) AS term FROM {rel}), post AS (SELECT {key}, term, count(*) AS tf FROM tok GROUP BY ALL),
sizes AS (SELECT {key}, len({TOKENS.format(text)}) AS len FROM {rel}), corpus AS (SELECT count(*) AS n, avg(len) AS avglen FROM sizes)"""


def _bm25_sql(rel: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""{_Q}, {_post_sql(rel, key, text)}, want AS (SELECT query_id, {key}, term, tf FROM post JOIN q USING (term)), df AS (SELECT term, count(DISTINCT {key}) AS df FROM want GROUP BY 1),
ranked AS (SELECT query_id, {key}, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))), 6) AS score FROM want JOIN df USING (term) JOIN sizes USING ({key}), corpus GROUP BY 1, 2)"""


_POST, _BM25 = _post_sql(), _bm25_sql()
_SECTION_SCORES = f"secs AS (SELECT doc_id || ':' || (i - 1) AS section, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, range(1, len(l) + 1) t(i)), {_bm25_sql('secs', 'section', 'line')}"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return S.bm25(_documents(spark, sf), "doc_id", F.col("text"), _queries(spark, sf), S.corpus(T.table(spark, sf, "documents"), F.col("text")))


def bm25_docs(spark: SparkSession, sf: str) -> DataFrame:
    return S.top_per(_scores(spark, sf), "query_id", [F.desc("score"), F.col("doc_id")], MOST)


def find_bm25_top20(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: best documents over all benchmark queries, one row a document, by its best score."""
    best = _scores(spark, sf).groupBy("doc_id").agg(F.max("score").alias("score"), F.count("*").alias("queries"))
    return best.orderBy(F.desc("score"), "doc_id").limit(MOST)


def _section_scores(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over the lines of documents as sections, by doc_id and ordinal."""
    line = F.split("text", "\n")
    over = S.corpus(T.table(spark, sf, "documents").select(F.explode(line).alias("line")), F.col("line"))
    # the outer kind: no filter on lines, so documents are dealt once for them and for _scores; a null line has no hits
    lines = _documents(spark, sf).select("doc_id", F.posexplode_outer(line).alias("ordinal", "line"))
    return S.bm25(lines, ["doc_id", "ordinal"], F.col("line"), _queries(spark, sf), over)


def bm25_sections(spark: SparkSession, sf: str) -> DataFrame:
    scores = _section_scores(spark, sf).select("query_id", F.concat_ws(":", "doc_id", "ordinal").alias("section"), "score")
    return S.top_per(scores, "query_id", [F.desc("score"), F.col("section")], 5)


def fts_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold all tokens of a benchmark text."""
    q = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tokens("text")).alias("term"))
    return S.all_terms(T.table(spark, sf, "documents"), F.col("text"), q, "doc_id")


def fts_like_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark text, every second one cut inside its words at both ends: all-terms matches, and where there are none,
    the artifacts whose title, path or body hold the text itself."""
    cut = F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.expr("substring(text, 3, length(text) - 5)"))
    q = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), cut.alias("text"))
    fts = S.all_terms(T.table(spark, sf, "documents"), F.col("text"), q.select("query_id", F.explode(tokens("text")).alias("term")), "doc_id")
    rest = q.join(fts.select("query_id").distinct(), "query_id", "left_anti")
    like = P.holding(T.artifacts(spark, sf), "artifact_id", [F.col(c) for c in ("title", "path", "body")], rest).select("query_id", F.col("artifact_id").alias("doc_id"))
    return fts.withColumn("lane", F.lit("fts")).unionByName(like.withColumn("lane", F.lit("like")))


def fts_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of a quoted phrase, a word and a prefix from each benchmark text, over title, path and body."""
    word = lambda i: F.get(F.col("w"), F.lit(i))
    phrase = F.concat(F.lit('"'), F.array_join(F.slice("w", 1, 3), " "), F.lit('"'))
    text = F.concat_ws(" ", phrase, word(5), F.concat(F.left(word(7), F.lit(3)), F.lit("*")))
    q = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), tokens("text").alias("w")).select("query_id", text.alias("text"))
    return P.matches(T.artifacts(spark, sf), "artifact_id", {c: F.col(c) for c in ("title", "path", "body")}, q)


def preselect_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered union of three lanes (documents by score, documents by a line's score, titles), first wins."""
    scores = _scores(spark, sf).groupBy("doc_id").agg(F.max("score").alias("score"))
    lane = lambda df, *order: df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    one = lane(scores.orderBy(F.desc("score"), "doc_id").limit(40), F.desc("score"), "doc_id")
    sections = _section_scores(spark, sf).groupBy("doc_id").agg(F.max("score").alias("score"))
    two = lane(sections.orderBy(F.desc("score"), "doc_id").limit(60), F.desc("score"), "doc_id")
    three = lane(T.artifacts(spark, sf).where(F.lower("title").contains("tion")).select(F.col("artifact_id").alias("doc_id")).orderBy("doc_id").limit(80), "doc_id")
    return S.lanes_union([one, two, three], "doc_id", 120)


def baseline_any_term(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold any term of a query as a token, with how many of its terms."""
    q = _queries(spark, sf)
    return S.hits(T.table(spark, sf, "documents"), "doc_id", F.col("text"), q.select("term").distinct()).join(q, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("terms"))


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = T.table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size(tokens("text"))).alias("tokens"), F.sum(token_estimate("text")).alias("estimate"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(occurrences("text", "the", 50)).alias("the"))


def vocab_idf(spark: SparkSession, sf: str) -> DataFrame:
    """Total, document frequency and clamped local idf of each token that three documents hold."""
    docs = T.table(spark, sf, "documents")
    n = docs.agg(F.count("*").alias("n"))
    v = S.postings(docs, "doc_id", F.col("text")).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).where("df >= 3")
    local = F.least(F.greatest(1 + F.log((F.col("n") + 1) / (F.col("df") + 1)), F.lit(0.7)), F.lit(3.0))
    return v.join(F.broadcast(n)).select("term", "total", "df", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"), F.round(local, 6).alias("local_idf"))


def local_terms_top30(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's repeated terms: the thirty most frequent, listed by name."""
    p = S.postings(T.table(spark, sf, "documents"), "doc_id", F.col("text")).where("tf >= 2")
    top = S.top_per(p, "doc_id", [F.desc("tf"), F.col("term")], 30)
    return top.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("terms"), F.count("*").alias("n"))


def noisy_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.table(spark, sf, "documents")
    n = docs.agg(F.count("*").alias("n"))
    df = S.postings(docs, "doc_id", F.col("text")).groupBy("term").agg(F.count("*").alias("df"))
    share = F.col("df") / F.col("n")
    return df.join(F.broadcast(n)).where((F.col("df") >= 8) & (share >= 0.2)).select("term", "df", F.round(share, 6).alias("share"))


def ngram_phrases(spark: SparkSession, sf: str) -> DataFrame:
    p = T.table(spark, sf, "benchmark").select("item_id", F.explode(ngrams(tokens("text"), 2)).alias("phrase"))
    return p.groupBy("phrase").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items")).where("n >= 2")


def search_terms(spark: SparkSession, sf: str) -> DataFrame:
    b = T.table(spark, sf, "benchmark")
    return b.select("item_id", F.array_join(query_terms("text"), " ").alias("terms"), normalized("text").alias("phrase"))


def identifier_split(spark: SparkSession, sf: str) -> DataFrame:
    p = T.table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(identifier_parts(F.concat(F.regexp_replace("p_name", " ", ""), F.lit("_"), "p_type", F.lit("-v2"))), "|").alias("parts"))


QUERIES = {f.__name__: f for f in (find_bm25_top20, bm25_docs, bm25_sections, fts_all_terms, fts_like_fallback, fts_phrases, preselect_lanes, baseline_any_term, token_stats, vocab_idf, local_terms_top30, noisy_terms, ngram_phrases, search_terms, identifier_split)}

_STOP = ", ".join(f"'{w}'" for w in ("the", "and", "for", "with", "from", "that", "this", "into", "are", "was", "how", "what"))
SQL = {
    "find_bm25_top20": f"WITH {_BM25} SELECT doc_id, max(score) AS score, count(*) AS queries FROM ranked GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {MOST}",
    "bm25_docs": f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ranked) SELECT * FROM r WHERE rank <= {MOST}",
    "bm25_sections": f"""WITH {_SECTION_SCORES},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section) AS rank FROM ranked) SELECT query_id, section, score, rank FROM r WHERE rank <= 5""",
    "fts_all_terms": f"""WITH q AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark), d AS (SELECT DISTINCT * FROM q), need AS (SELECT query_id, count(*) AS need FROM d GROUP BY 1), {_POST},
g AS (SELECT query_id, doc_id, count(*) AS got FROM post JOIN d USING (term) GROUP BY 1, 2) SELECT query_id, doc_id FROM g JOIN need USING (query_id) WHERE got = need""",
    "fts_like_fallback": f"""WITH {T.ARTIFACTS}, c AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN text ELSE substr(text, 3, length(text) - 5) END AS text FROM benchmark),
d AS (SELECT DISTINCT query_id, unnest({TOKENS.format('text')}) AS term FROM c), need AS (SELECT query_id, count(*) AS need FROM d GROUP BY 1), {_POST},
g AS (SELECT query_id, doc_id, count(*) AS got FROM post JOIN d USING (term) GROUP BY 1, 2), f AS (SELECT query_id, doc_id FROM g JOIN need USING (query_id) WHERE got = need)
SELECT query_id, doc_id, 'fts' AS lane FROM f UNION ALL SELECT query_id, artifact_id, 'like' FROM c, artifacts WHERE query_id NOT IN (SELECT query_id FROM f) AND (contains(lower(title), lower(text)) OR contains(lower(path), lower(text)) OR contains(lower(body), lower(text)))""",
    "fts_phrases": f"""WITH {T.ARTIFACTS}, w AS (SELECT item_id AS query_id, {TOKENS.format('text')} AS w FROM benchmark),
f AS (SELECT artifact_id, field, {TOKENS.format('words')} AS t FROM (SELECT artifact_id, unnest([{{'field': 'title', 'words': title}}, {{'field': 'path', 'words': path}}, {{'field': 'body', 'words': body}}], recursive := true) FROM artifacts)),
pos AS (SELECT artifact_id, field, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM f),
three AS (SELECT query_id, a.artifact_id FROM w JOIN pos a ON a.term = w[1] JOIN pos b ON b.artifact_id = a.artifact_id AND b.field = a.field AND b.pos = a.pos + 1 AND b.term = w[2] JOIN pos c ON c.artifact_id = a.artifact_id AND c.field = a.field AND c.pos = a.pos + 2 AND c.term = w[3]),
p AS (SELECT query_id, artifact_id, count(*) AS n FROM three GROUP BY 1, 2), o AS (SELECT query_id, artifact_id, count(*) AS n FROM w JOIN pos ON term = w[6] GROUP BY 1, 2), s AS (SELECT query_id, artifact_id, count(*) AS n FROM w JOIN pos ON starts_with(term, w[8][1:3]) GROUP BY 1, 2)
SELECT query_id, artifact_id, CAST(p.n + o.n + s.n AS BIGINT) AS hits FROM p JOIN o USING (query_id, artifact_id) JOIN s USING (query_id, artifact_id)""",
    "preselect_lanes": f"""WITH {_BM25}, {T.ARTIFACTS}, s AS (SELECT doc_id, max(score) AS score FROM ranked GROUP BY 1),
one AS (SELECT doc_id, 0 AS lane, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM s ORDER BY pos LIMIT 40), x AS (WITH {_SECTION_SCORES} SELECT CAST(split_part(section, ':', 1) AS BIGINT) AS doc_id, max(score) AS score FROM ranked GROUP BY 1),
two AS (SELECT doc_id, 1, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM x ORDER BY pos LIMIT 60),
three AS (SELECT artifact_id, 2, row_number() OVER (ORDER BY artifact_id) AS pos FROM artifacts WHERE contains(lower(title), 'tion') ORDER BY pos LIMIT 80), u AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three),
m AS (SELECT doc_id, min((lane, pos)) AS f FROM u GROUP BY 1), r AS (SELECT doc_id, f[1] AS lane, f[2] AS pos FROM m) SELECT doc_id, CAST(lane AS INT) AS lane, CAST(pos AS BIGINT) AS pos, row_number() OVER (ORDER BY lane, pos, doc_id) AS rank FROM r ORDER BY rank LIMIT 120""",
    "baseline_any_term": f"WITH {_Q}, {_POST} SELECT query_id, doc_id, count(*) AS terms FROM post JOIN q USING (term) GROUP BY 1, 2",
    "token_stats": f"SELECT lang, count(*) AS docs, CAST(sum(len({TOKENS.format('text')})) AS BIGINT) AS tokens, CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS estimate, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(least((strlen(text) - strlen(replace(text, 'the', ''))) // 3, 50)) AS BIGINT) AS the FROM documents GROUP BY lang",
    "vocab_idf": f"WITH {_POST}, v AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM post GROUP BY 1 HAVING count(*) >= 3) SELECT term, total, df, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf, round(least(greatest(1 + ln((n + 1) / (df + 1)), 0.7), 3.0), 6) AS local_idf FROM v, corpus",
    "local_terms_top30": f"WITH {_POST}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS r FROM post WHERE tf >= 2) SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS terms, count(*) AS n FROM r WHERE r <= 30 GROUP BY doc_id",
    "noisy_terms": f"WITH {_POST}, v AS (SELECT term, count(*) AS df FROM post GROUP BY 1) SELECT term, df, round(df / n, 6) AS share FROM v, corpus WHERE df >= 8 AND df / n >= 0.2",
    "ngram_phrases": f"WITH t AS (SELECT item_id, {TOKENS.format('text')} AS w FROM benchmark), p AS (SELECT item_id, w[i] || ' ' || w[i + 1] AS phrase FROM t, range(1, len(w)) x(i)) SELECT phrase, count(*) AS n, count(DISTINCT item_id) AS items FROM p GROUP BY 1 HAVING count(*) >= 2",
    "search_terms": rf"""WITH r AS (SELECT item_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_.-]+') AS w FROM benchmark), d AS (SELECT item_id, text, list_filter(w, lambda t, i: list_position(w, t) = i) AS w FROM r)
SELECT item_id, array_to_string(list_filter(w, lambda t: strlen(t) >= 3 AND t NOT IN ({_STOP}))[1:12], ' ') AS terms, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS phrase FROM d""",
    "identifier_split": r"""WITH s AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(regexp_replace(replace(p_name, ' ', '') || '_' || p_type || '-v2', '([\p{Ll}\p{Nd}])(\p{Lu})', '\1 \2', 'g')), '[\s_./-]+'), lambda t: t <> '') AS w FROM part)
SELECT p_partkey, array_to_string(list_filter(w, lambda t, i: list_position(w, t) = i), '|') AS parts FROM s""",
}
