"""Ranking and packing: roles, priors, budgets, variants, siblings, thresholds, receipts, first-fit packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import token_estimate
from ..operators import packing as P
from ..operators.search import top_per
from ..sources import tables as T

PACK_TOKENS = 4096


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts with role, token estimate and their rank in their repository (longest first)."""
    a = T.artifacts(spark, sf).withColumn("tokens", token_estimate("body")).withColumn("role", P.role_case(F.col("kind"), paths.path_class("path"), F.col("status")))
    return a.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("tokens"), "artifact_id")).cast("long"))


_CAND = f"""{T.ARTIFACTS}, cand AS (SELECT *, (strlen(body) + 3) // 4 AS tokens,
  CASE WHEN status = 'superseded' THEN 'noise' WHEN kind = 'decision' THEN 'decision' WHEN kind = 'requirements' THEN 'primary' WHEN kind = 'plan' THEN 'plan' ELSE 'background' END AS role FROM artifacts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY tokens DESC, artifact_id) AS rank FROM cand)"""


def role_case(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).groupBy("repo_id", "role").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def authority_prior(spark: SparkSession, sf: str) -> DataFrame:
    """A sum of cues, with the names of those that hold."""
    cues = [("accepted", F.col("status") == "accepted", 2.5), ("active", F.col("status") == "active", 1.5), ("superseded", F.col("status") == "superseded", -4.0), ("decision", F.col("kind") == "decision", 1.0), ("long", F.octet_length("body") >= 4000, 0.5)]
    score = sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for _, c, w in cues), F.lit(0.0))
    reasons = F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c, _ in cues])
    return T.artifacts(spark, sf).select("artifact_id", score.alias("prior"), reasons.alias("reasons"))


def current_intent(spark: SparkSession, sf: str) -> DataFrame:
    """Where any artifact of a repository is active, active ones gain and superseded ones lose."""
    a = T.artifacts(spark, sf)
    some = F.max(F.col("status") == "active").over(Window.partitionBy("repo_id"))
    gain = F.when(some & (F.col("status") == "active"), 18).when(some & (F.col("status") == "superseded"), -120).otherwise(0)
    return a.select("artifact_id", gain.cast("long").alias("gain"))


def role_budget_pack(spark: SparkSession, sf: str) -> DataFrame:
    return P.budgeted(_candidates(spark, sf).select("repo_id", "artifact_id", "role", "rank"), "repo_id").where("shown").select("repo_id", "role", "artifact_id", "place")


def pack_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.pack_summary(P.budgeted(_candidates(spark, sf).select("repo_id", "role", "rank"), "repo_id"), "repo_id")


def pack_first_fit(spark: SparkSession, sf: str) -> DataFrame:
    return P.first_fit(_candidates(spark, sf).select("repo_id", "rank", "tokens"), "repo_id", "tokens", PACK_TOKENS)


def variant_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Artifacts with the same first 40 characters of the title are variants; accepted ones are kept apart."""
    a = _candidates(spark, sf).select("artifact_id", "path", "status", "tokens", F.concat_ws("|", "role", F.lower(F.substring("title", 1, 40))).alias("print"))
    out = P.variant_collapsed(a, F.col("print"), [F.desc("tokens"), F.col("artifact_id")], F.col("status") == "accepted")
    return out.select("artifact_id", "collapsed")


def sibling_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """The best of the siblings (repository and kind) gains, far weaker ones lose."""
    w = Window.partitionBy("repo_id", "kind")
    a = _candidates(spark, sf).withColumn("best", F.max("tokens").over(w)).withColumn("n", F.count("*").over(w))
    delta = F.when(F.col("n") < 2, 0.0).when(F.col("tokens") == F.col("best"), 0.9).when(F.col("tokens") * 4 < F.col("best"), -2.0).otherwise(-0.8)
    return a.select("artifact_id", delta.alias("delta"))


def select_limit(spark: SparkSession, sf: str) -> DataFrame:
    """At least 55 % of the best of the repository, and at most five; plans at most two."""
    a = _candidates(spark, sf).withColumn("best", F.max("tokens").over(Window.partitionBy("repo_id"))).where("tokens * 100 >= best * 55")
    a = a.withColumn("typed", F.row_number().over(Window.partitionBy("repo_id", "kind").orderBy("rank"))).where("kind != 'plan' OR typed <= 2")
    return top_per(a, "repo_id", [F.col("rank")], 5, "place").select("repo_id", "artifact_id", "place")


def section_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as sections: a fixed gain for the speaker, and one for each term up to three hits."""
    hits = [F.least(F.regexp_count(F.lower("text"), F.lit(t)), F.lit(3)) for t in ("tion", "the", "eau")]
    score = F.when(F.col("role") == "user", 5.0).otherwise(0.0) + 1.4 * sum(hits, F.lit(0))
    c = T.table(spark, sf, "conversations").select("conv_id", "turn", F.round(score, 3).alias("score"))
    best = c.withColumn("best", F.max("score").over(Window.partitionBy("conv_id"))).where((F.col("score") >= 4.8) & (F.col("score") >= F.round(F.col("best") * 0.55, 3)))
    return top_per(best, "conv_id", [F.desc("score"), F.col("turn")], 3).select("conv_id", "turn", "score", "rank")


def git_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """The three best commits of each author by paths, references and kind of change."""
    c = T.commits(spark, sf)
    n = T.commit_files(spark, sf).groupBy("commit_id").agg(F.count_distinct("path").alias("paths"))
    score = 20 + 5 * F.least(F.col("paths"), F.lit(4)) + F.when(F.col("subject").rlike("[A-Z]+-[0-9]*7"), 3).otherwise(0) + F.when(F.col("subject").startswith("fix"), 4).otherwise(0)
    s = c.join(n, "commit_id").select("author", "sha", "commit_id", "committed_at", score.cast("long").alias("score"))
    return top_per(s, "author", [F.desc("score"), F.desc("committed_at"), F.col("commit_id")], 3).select("author", "sha", "score", "rank")


def test_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Tests of a source by its stem, better in the same folder and outside noise; the best two of each stem."""
    f = T.files(spark, sf).select("path", paths.source_stem("path").alias("stem"), paths.directory("path").alias("dir"), paths.is_test("path").alias("test"), paths.is_noise("path").alias("noise"))
    src, tests = f.where("NOT test").alias("s"), f.where("test").alias("t")
    pair = src.join(tests, F.col("s.stem") == F.col("t.stem"))
    score = 30 + F.when(F.col("s.dir") == F.col("t.dir"), 14).otherwise(0) - F.when(F.col("t.noise"), 20).otherwise(0)
    out = pair.select(F.col("s.path").alias("source"), F.col("t.path").alias("test"), score.cast("long").alias("score"))
    return top_per(out, "source", [F.desc("score"), F.col("test")], 2)


QUERIES = {f.__name__: f for f in (role_case, authority_prior, current_intent, role_budget_pack, pack_summary, pack_first_fit, variant_collapse, sibling_contrast, select_limit, section_evidence, git_receipts, test_receipts)}

_BUDGET = "CASE role WHEN 'source' THEN 6 WHEN 'test' THEN 5 WHEN 'noise' THEN 5 ELSE 3 END"
_PLACED = f"{_CAND}, placed AS (SELECT *, row_number() OVER (PARTITION BY repo_id, role ORDER BY rank) AS place FROM ranked), shown AS (SELECT *, place <= {_BUDGET} AS shown FROM placed)"
SQL = {
    "role_case": f"WITH {_CAND} SELECT repo_id, role, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM cand GROUP BY ALL",
    "authority_prior": f"""WITH {T.ARTIFACTS} SELECT artifact_id, CAST(CASE status WHEN 'accepted' THEN 2.5 WHEN 'active' THEN 1.5 WHEN 'superseded' THEN -4.0 ELSE 0.0 END + CASE WHEN kind = 'decision' THEN 1.0 ELSE 0.0 END + CASE WHEN strlen(body) >= 4000 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS prior,
  concat_ws(',', CASE WHEN status IN ('accepted', 'active', 'superseded') THEN status END, CASE WHEN kind = 'decision' THEN 'decision' END, CASE WHEN strlen(body) >= 4000 THEN 'long' END) AS reasons FROM artifacts""",
    "current_intent": f"WITH {T.ARTIFACTS}, s AS (SELECT artifact_id, status, bool_or(status = 'active') OVER (PARTITION BY repo_id) AS any_active FROM artifacts) SELECT artifact_id, CAST(CASE WHEN any_active AND status = 'active' THEN 18 WHEN any_active AND status = 'superseded' THEN -120 ELSE 0 END AS BIGINT) AS gain FROM s",
    "role_budget_pack": f"WITH {_PLACED} SELECT repo_id, role, artifact_id, place FROM shown WHERE shown",
    "pack_summary": f"WITH {_PLACED} SELECT repo_id, count(*) AS items, count(*) FILTER (WHERE shown) AS shown, count(DISTINCT role) AS roles, count(*) FILTER (WHERE NOT shown) AS overflow, bool_or(role = 'test') AS has_test, bool_or(role = 'source') AS has_source FROM shown GROUP BY repo_id",
    "pack_first_fit": f"""WITH RECURSIVE {_CAND}, small AS (SELECT repo_id, min(tokens) <= {PACK_TOKENS} AS fits FROM ranked GROUP BY 1),
step AS (SELECT repo_id, 0::BIGINT AS rank, {PACK_TOKENS}::BIGINT AS room, FALSE AS took FROM small UNION ALL
  SELECT r.repo_id, r.rank, CASE WHEN r.tokens <= s.room THEN s.room - r.tokens ELSE s.room END, r.tokens <= s.room FROM step s JOIN ranked r ON r.repo_id = s.repo_id AND r.rank = s.rank + 1)
SELECT repo_id, rank, tokens FROM step JOIN ranked USING (repo_id, rank) JOIN small USING (repo_id) WHERE CASE WHEN fits THEN took ELSE rank = 1 END""",
    "variant_collapse": f"""WITH {_CAND}, f AS (SELECT artifact_id, tokens, CASE WHEN status = 'accepted' THEN chr(1) || path ELSE role || '|' || lower(substr(title, 1, 40)) END AS f FROM cand),
r AS (SELECT artifact_id, row_number() OVER (PARTITION BY f ORDER BY tokens DESC, artifact_id) AS r, count(*) OVER (PARTITION BY f) - 1 AS collapsed FROM f) SELECT artifact_id, collapsed FROM r WHERE r = 1""",
    "sibling_contrast": f"WITH {_CAND}, s AS (SELECT artifact_id, tokens, max(tokens) OVER w AS best, count(*) OVER w AS n FROM cand WINDOW w AS (PARTITION BY repo_id, kind)) SELECT artifact_id, CAST(CASE WHEN n < 2 THEN 0.0 WHEN tokens = best THEN 0.9 WHEN tokens * 4 < best THEN -2.0 ELSE -0.8 END AS DOUBLE) AS delta FROM s",
    "select_limit": f"""WITH {_CAND}, b AS (SELECT *, max(tokens) OVER (PARTITION BY repo_id) AS best FROM ranked), k AS (SELECT *, row_number() OVER (PARTITION BY repo_id, kind ORDER BY rank) AS typed FROM b WHERE tokens * 100 >= best * 55),
p AS (SELECT repo_id, artifact_id, row_number() OVER (PARTITION BY repo_id ORDER BY rank) AS place FROM k WHERE kind <> 'plan' OR typed <= 2) SELECT * FROM p WHERE place <= 5""",
    "section_evidence": """WITH c AS (SELECT conv_id, turn, round(CAST(CASE role WHEN 'user' THEN 5.0 ELSE 0.0 END AS DOUBLE) + 1.4::DOUBLE * (least(len(regexp_extract_all(lower(text), 'tion')), 3) + least(len(regexp_extract_all(lower(text), 'the')), 3) + least(len(regexp_extract_all(lower(text), 'eau')), 3)), 3) AS score FROM conversations),
b AS (SELECT *, max(score) OVER (PARTITION BY conv_id) AS best FROM c), r AS (SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM b WHERE score >= 4.8 AND score >= round(best * 0.55::DOUBLE, 3)) SELECT * FROM r WHERE rank <= 3""",
    "git_receipts": f"""WITH {T.COMMITS}, {T.COMMIT_FILES}, n AS (SELECT commit_id, count(DISTINCT path) AS paths FROM commit_files GROUP BY 1),
s AS (SELECT author, sha, CAST(20 + 5 * least(paths, 4) + CASE WHEN regexp_matches(subject, '[A-Z]+-[0-9]*7') THEN 3 ELSE 0 END + CASE WHEN starts_with(subject, 'fix') THEN 4 ELSE 0 END AS BIGINT) AS score, committed_at, commit_id FROM commits JOIN n USING (commit_id)),
r AS (SELECT author, sha, score, row_number() OVER (PARTITION BY author ORDER BY score DESC, committed_at DESC, commit_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 3""",
    "test_receipts": f"""WITH {T.FILES}, f AS (SELECT path, regexp_replace(lower(split_part(split_part(path, '/', -1), '.', 1)), '_test$', '') AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, path LIKE '%\\_test.go' ESCAPE '\\' AS test, starts_with(path, 'vendor/') AS noise FROM files),
p AS (SELECT s.path AS source, t.path AS test, CAST(30 + CASE WHEN s.dir = t.dir THEN 14 ELSE 0 END - CASE WHEN t.noise THEN 20 ELSE 0 END AS BIGINT) AS score FROM f s JOIN f t ON s.stem = t.stem AND NOT s.test AND t.test),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, test) AS rank FROM p) SELECT * FROM r WHERE rank <= 2""",
}
