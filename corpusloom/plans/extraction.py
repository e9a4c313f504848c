"""Extraction: markdown sections, checklists, references, html headings, dialogue sections, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, derived_id, shortened, token_estimate
from ..operators import extraction as X
from ..operators.greedy import greedy_capped, slot
from ..operators.state import short_ids
from ..sources import tables as T


def sections_markdown(spark: SparkSession, sf: str) -> DataFrame:
    s = X.sections(T.markdown(spark, sf), "artifact_id")
    return s.select("artifact_id", "ordinal", "depth", "title", "heading_path", "start_line", "end_line", "tokens")


def todos_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return X.checklist(T.markdown(spark, sf), "artifact_id").where("criteria_kind IS NULL").select("artifact_id", "ordinal", "line_no", "done", "text")


def criteria_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return X.checklist(T.markdown(spark, sf), "artifact_id").where("criteria_kind IS NOT NULL").select("artifact_id", "criteria_kind", "ordinal", "done", "text")


def fence_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.with_fences(X.lines(T.markdown(spark, sf), "artifact_id"), "artifact_id")
    return rows.groupBy("artifact_id").agg(F.count("*").alias("lines"), F.count_if("is_fence").alias("fences"), F.count_if("in_fence").alias("fenced"))


def enclosing_section(spark: SparkSession, sf: str) -> DataFrame:
    """The innermost section around each checklist line: an equi join on the artifact with a range on lines."""
    md = T.markdown(spark, sf)
    items = X.checklist(md, "artifact_id").select("artifact_id", "line_no")
    s = X.sections(md, "artifact_id").select("artifact_id", "title", "start_line", "end_line")
    hit = items.join(s, "artifact_id").where("line_no BETWEEN start_line AND end_line")
    return hit.groupBy("artifact_id", "line_no").agg(F.max_by("title", "start_line").alias("section"))


def markdown_references(spark: SparkSession, sf: str) -> DataFrame:
    md = T.markdown(spark, sf)
    join = lambda c: F.array_join(c, "|")
    return md.select("artifact_id", join(X.link_targets("body")).alias("links"), join(X.path_references("body")).alias("paths"), join(X.dates("body")).alias("dates"), X.title("body", F.lit("docs/x.md")).alias("title"), X.front_matter("body", "status").alias("status"), token_estimate("body").alias("tokens"))


def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Links of plans to customers that exist."""
    refs = T.markdown(spark, sf).select("artifact_id", F.explode(X.link_targets("body")).alias("target"))
    key = F.regexp_extract("target", r"^customers/(\d+)\.md$", 1).cast("long")
    return refs.select("artifact_id", key.alias("c_custkey")).join(T.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").select("artifact_id", "c_custkey", "c_name")


def path_reference_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Plans that mention the path of another plan, by target and source: a source has four places and a target 32, and a
    full target takes none of its source's places."""
    refs = T.markdown(spark, sf).select(F.col("artifact_id").alias("src"), F.explode(X.path_references("body")).alias("path"))
    known = T.table(spark, sf, "orders").select(F.concat(F.lit("docs/plans/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), F.col("o_orderkey").alias("dst"))
    hit = refs.join(known, "path").where("src != dst").select("src", "dst")
    return greedy_capped(hit, [F.col("dst"), F.col("src")], [slot("source", 4, "src"), slot("target", 32, "dst")])


def sections_html(spark: SparkSession, sf: str) -> DataFrame:
    pages = T.table(spark, sf, "pages")
    head = F.regexp_extract("html", r"<h1>(.*?)</h1>", 1)
    return pages.select("page_id", head.alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.octet_length("html").cast("long").alias("bytes"))


def sections_dialogue(spark: SparkSession, sf: str) -> DataFrame:
    c = T.table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", "role", F.coalesce(F.lag("role").over(w), F.lit("")).alias("before"), F.sum(token_estimate("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tokens_so_far"), shortened("text", 30).alias("head"))


def content_hash_dups(spark: SparkSession, sf: str) -> DataFrame:
    a = T.table(spark, sf, "documents").select("doc_id", content_hash("text").alias("digest"))
    return a.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def duplicate_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each copy with the first document of its content hash."""
    a = T.table(spark, sf, "documents").select("doc_id", content_hash("text").alias("digest"))
    first = a.groupBy("digest").agg(F.min("doc_id").alias("target"))
    return a.join(first, "digest").where("doc_id > target").select("doc_id", "target")


def derived_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = T.artifacts(spark, sf)
    return d.select("artifact_id", derived_id("sec_", 16, F.col("repo_id"), F.col("path"), F.col("title")).alias("section_id"), derived_id("src_", 24, F.col("repo_id"), F.col("path")).alias("manifest_id"))


def short_id_suffix(spark: SparkSession, sf: str) -> DataFrame:
    d = T.artifacts(spark, sf)
    return short_ids(d, F.substring(F.sha2("title", 256), 1, 3), [F.col("artifact_id")]).select("artifact_id", "short_id")


def ticket_anchors(spark: SparkSession, sf: str) -> DataFrame:
    c = T.commits(spark, sf)
    return c.select("commit_id", F.explode(X.ticket_references("subject")).alias("ref")).groupBy("ref").agg(F.count("*").alias("n"), F.min("commit_id").alias("first_commit"))


def status_normalized(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders")
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Done "), "o_orderpriority")).when(F.col("o_orderstatus") == "O", "Proposed (WIP)").otherwise("Replaced by later order")
    return o.groupBy(X.status(raw).alias("status")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


QUERIES = {f.__name__: f for f in (sections_markdown, todos_markdown, criteria_markdown, fence_state, enclosing_section, markdown_references, link_edges, path_reference_edges, sections_html, sections_dialogue, content_hash_dups, duplicate_links, derived_ids, short_id_suffix, ticket_anchors, status_normalized)}

_LINES = f"""{T.MARKDOWN}, raw AS (SELECT artifact_id, string_split(body, chr(10)) AS l FROM markdown), ln AS (SELECT artifact_id, i AS line_no, l[i] AS line FROM raw, range(1, len(l) + 1) t(i)),
f1 AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS is_fence FROM ln), f2 AS (SELECT *, sum(CASE WHEN is_fence THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id ORDER BY line_no) % 2 = 1 AND NOT is_fence AS in_fence FROM f1)"""
_SECTIONS = rf"""{_LINES}, hd AS (SELECT artifact_id, line_no, len(regexp_extract(line, '^(#{{1,6}})[ \t]+(.*?)[ \t]*#*[ \t]*$', 1)) AS depth, regexp_extract(line, '^(#{{1,6}})[ \t]+(.*?)[ \t]*#*[ \t]*$', 2) AS title
  FROM f2 WHERE NOT is_fence AND NOT in_fence AND regexp_matches(line, '^(#{{1,6}})[ \t]+(.*?)[ \t]*#*[ \t]*$')), ends AS (SELECT artifact_id, max(line_no) AS total FROM ln GROUP BY 1),
sec AS (SELECT artifact_id, row_number() OVER w AS ordinal, depth, title, line_no AS start_line, coalesce(lead(line_no) OVER w - 1, total) AS end_line FROM hd JOIN ends USING (artifact_id) WINDOW w AS (PARTITION BY artifact_id ORDER BY line_no))"""
_ITEMS = rf"""{_LINES}, hs AS (SELECT *, CASE WHEN NOT is_fence AND NOT in_fence AND regexp_matches(line, '^(#{{1,6}})\s*(.*?)\s*$') THEN lower(regexp_extract(line, '^(#{{1,6}})\s*(.*?)\s*$', 2)) END AS h FROM f2),
hl AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY artifact_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading FROM hs),
it AS (SELECT artifact_id, line_no, lower(regexp_extract(line, '^\s*[-*+] \[([ xX])\] (.+?)\s*$', 1)) = 'x' AS done, regexp_extract(line, '^\s*[-*+] \[([ xX])\] (.+?)\s*$', 2) AS text,
  CASE WHEN contains(heading, 'okr') OR contains(heading, 'key result') THEN 'okr' WHEN contains(heading, 'acceptance') THEN 'acceptance' WHEN contains(heading, 'success') THEN 'success' END AS criteria_kind
  FROM hl WHERE NOT is_fence AND NOT in_fence AND regexp_matches(line, '^\s*[-*+] \[([ xX])\] (.+?)\s*$')),
items2 AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, criteria_kind IS NULL ORDER BY line_no) - 1 AS ordinal FROM it)"""
_DIGEST = r"sha256(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+(\n)', '\1', 'g'), '[ \t]+\z', ''))"
SQL = {
    "sections_markdown": f"""WITH {_SECTIONS}, txt AS (SELECT s.artifact_id, s.ordinal, string_agg(line, chr(10) ORDER BY line_no) AS text FROM sec s JOIN ln ON ln.artifact_id = s.artifact_id AND line_no BETWEEN start_line AND end_line GROUP BY 1, 2),
up AS (SELECT a.artifact_id, a.ordinal, string_agg(b.title, ' > ' ORDER BY b.ordinal) AS heading_path FROM sec a JOIN sec b ON a.artifact_id = b.artifact_id AND b.ordinal <= a.ordinal AND (b.ordinal = a.ordinal OR b.depth < a.depth)
  AND NOT EXISTS (SELECT 1 FROM sec c WHERE c.artifact_id = a.artifact_id AND c.ordinal > b.ordinal AND c.ordinal <= a.ordinal AND c.depth <= b.depth) GROUP BY 1, 2)
SELECT artifact_id, ordinal, depth, title, heading_path, start_line, end_line, (strlen(text) + 3) // 4 AS tokens FROM sec JOIN txt USING (artifact_id, ordinal) JOIN up USING (artifact_id, ordinal)""",
    "todos_markdown": f"WITH {_ITEMS} SELECT artifact_id, ordinal, line_no, done, text FROM items2 WHERE criteria_kind IS NULL",
    "criteria_markdown": f"WITH {_ITEMS} SELECT artifact_id, criteria_kind, ordinal, done, text FROM items2 WHERE criteria_kind IS NOT NULL",
    "fence_state": f"WITH {_LINES} SELECT artifact_id, count(*) AS lines, count(*) FILTER (WHERE is_fence) AS fences, count(*) FILTER (WHERE in_fence) AS fenced FROM f2 GROUP BY 1",
    "enclosing_section": f"WITH {_SECTIONS}, c AS (SELECT artifact_id, line_no FROM f2 WHERE NOT is_fence AND NOT in_fence AND regexp_matches(line, '^\\s*[-*+] \\[([ xX])\\] (.+?)\\s*$')) SELECT c.artifact_id, c.line_no, max_by(title, start_line) AS section FROM c JOIN sec s ON s.artifact_id = c.artifact_id AND line_no BETWEEN start_line AND end_line GROUP BY 1, 2",
    "markdown_references": rf"""WITH {T.MARKDOWN} SELECT artifact_id, array_to_string(list_sort(list_distinct(regexp_extract_all(body, '\[[^\]]*\]\(([^)\s]+)\)', 1))), '|') AS links,
  array_to_string(list_sort(list_distinct(regexp_extract_all(body, '(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_-]+\.[A-Za-z0-9]+'))), '|') AS paths, array_to_string(list_sort(list_distinct(regexp_extract_all(body, '\d{{4}}-\d{{2}}-\d{{2}}'))), '|') AS dates,
  regexp_extract(body, 'title: ([^\n]*)', 1) AS title, regexp_extract(body, 'status: ([^\n]*)', 1) AS status, (strlen(body) + 3) // 4 AS tokens FROM markdown""",
    "link_edges": "SELECT o_orderkey AS artifact_id, c_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey)",
    "path_reference_edges": """WITH h AS (SELECT s.o_orderkey AS src, d.o_orderkey AS dst FROM orders s JOIN orders d ON s.o_custkey % 97 = d.o_orderkey WHERE s.o_orderkey <> d.o_orderkey AND s.o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey)),
a AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM h), b AS (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM a WHERE r <= 4) SELECT src, dst FROM b WHERE r <= 32""",
    "sections_html": "SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS BIGINT) AS links, strlen(html) AS bytes FROM pages",
    "sections_dialogue": "SELECT conv_id, turn, role, coalesce(lag(role) OVER w, '') AS before, CAST(sum((strlen(text) + 3) // 4) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens_so_far, CASE WHEN length(text) > 30 THEN substr(text, 1, 29) || '…' ELSE text END AS head FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "content_hash_dups": f"SELECT {_DIGEST} AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "duplicate_links": f"WITH a AS (SELECT doc_id, {_DIGEST} AS digest FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY digest) AS target FROM a) SELECT doc_id, target FROM f WHERE doc_id > target",
    "derived_ids": f"WITH {T.ARTIFACTS} SELECT artifact_id, 'sec_' || substr(sha256(repo_id || chr(0) || path || chr(0) || title), 1, 16) AS section_id, 'src_' || substr(sha256(repo_id || chr(0) || path), 1, 24) AS manifest_id FROM artifacts",
    "short_id_suffix": f"WITH {T.ARTIFACTS}, b AS (SELECT artifact_id, substr(sha256(title), 1, 3) AS base FROM artifacts), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY artifact_id) - 1 AS n FROM b) SELECT artifact_id, base || CASE WHEN n > 0 THEN CAST(n AS VARCHAR) ELSE '' END AS short_id FROM r",
    "ticket_anchors": rf"WITH {T.COMMITS}, r AS (SELECT commit_id, unnest(list_distinct(regexp_extract_all(subject, '\b[A-Z][A-Z0-9]{{1,9}}-[0-9]{{1,6}}\b'))) AS ref FROM commits) SELECT ref, count(*) AS n, min(commit_id) AS first_commit FROM r GROUP BY ref",
    "status_normalized": "SELECT CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'draft' ELSE 'superseded' END AS status, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1",
}
