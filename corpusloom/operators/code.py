"""Source files as relations: test units, intent comments, symbols, test names, imports and path terms.

A file's lines are one window partition (its size is that of a file). What a scan would carry from line to line, such as an
annotation that waits for its function or an open block comment, is the last event before the line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import col, filled
from .extraction import lines

MOST_UNIT_LINES, MOST_COMMENT_LINES, MOST_IMPORTS, LONGEST_NAME = 120, 40, 6, 160

# Patterns of names, tests and imports, in the order in which they are looked for.
TEST_NAMES = (
    r"(?m)\bfunc\s+(Test[A-Za-z0-9_]+)\s*\(",
    r"(?m)\bdef\s+(test_[A-Za-z0-9_]+)\s*\(",
    r"(?m)\bfn\s+(test_[A-Za-z0-9_]+)\s*\(",
    r"(?m)\b(?:describe|it|test)\s*\(\s*['\"`]([^'\"`]{3,120})['\"`]",
)
SYMBOLS = (
    r"(?m)\bfunc\s+(?:\([^)]+\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"(?m)\btype\s+([A-Za-z_][A-Za-z0-9_]*)\b",
    r"(?m)\b(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)\s*[\(:]",
    r"(?m)\b(?:function|class|interface|type|enum)\s+([A-Za-z_$][A-Za-z0-9_$]*)\b",
    r"(?m)\b(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*[=:]",
    r"(?m)\b(?:fn|struct|enum|trait|impl)\s+([A-Za-z_][A-Za-z0-9_]*)\b",
)
IMPORTS = (
    r"(?m)^\s*import\s+([A-Za-z0-9_./:\-@]+)",
    r"(?m)^\s*from\s+([A-Za-z0-9_./:\-@]+)\s+import\b",
    r"(?m)\b(?:import|require)\s*\(\s*['\"`]([^'\"`]{1,160})['\"`]",
    r"(?m)\bfrom\s+['\"`]([^'\"`]{1,160})['\"`]",
    r"(?m)^\s*use\s+([A-Za-z0-9_:]+)",
    r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z0-9_.*]+)\s*;",
    r"(?m)^\s*#include\s+[<\"]([^>\"]+)[>\"]",
)
# First segments of imports from the same repository.
LOCAL_ROOTS = ("app", "apps", "backend", "client", "cmd", "components", "core", "crates", "frontend", "internal", "lib", "modules", "packages", "pkg", "plugin", "plugins", "script", "scripts", "sdk", "sdks", "service", "services", "src", "test", "tests", "ui", "web")
# Words that give a comment its role; the first role with a word in the comment holds.
COMMENT_ROLES = {
    "todo": ("todo", "fixme", "xxx"),
    "workaround": ("hack", "workaround", "temporary", "for now"),
    "invariant": ("invariant", "must always", "never", "do not", "don't", "cannot", "must not"),
    "rationale": ("because", "rationale", "reason", "why", "so that"),
    "constraint": ("assume", "assumption", "guarantee", "constraint", "contract"),
    "security": ("security", "permission", "auth", "sanitize", "validate", "validation"),
    "compatibility": ("compatibility", "backwards compatible", "legacy", "migration"),
    "behavior": ("edge case", "regression", "expected behavior", "behaviour", "behavior"),
}
LICENCE_WORDS = ("copyright", "licensed under", "permission is hereby granted", "apache license", "mit license")
KEPT_IN_LICENCES = ("todo", "fixme", "hack", "workaround", "invariant", "assumption")
QUOTED = r"""(["'`])(.*?)(?<!\\)\1"""
NOT_METHODS = r"(?i)^(?:class|interface|if|for|while|switch) | (?:class|interface) "


def _trim(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def _any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def code_lines(files: DataFrame) -> DataFrame:
    """path, language, line_no, line (trimmed) of files (path, body)."""
    return lines(files, "path").select("path", paths.language("path").alias("language"), "line_no", _trim("line").alias("line"))


def _when_matched(line: Column, pattern: str, group: int) -> Column:
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group))


def _jvm_method(line: Column) -> Column:
    """The name before the first parenthesis (in Kotlin the one after fun), null where the line begins no method."""
    fun = F.regexp_extract(line, r"fun\s+(?:`([^`]*)`|[^`(][^(]*)", 1)
    named = F.when(fun != "", fun).otherwise(_trim(F.regexp_extract(line, r"^.*?fun\s+([^(]*)\(", 1)))
    before = F.regexp_replace(F.regexp_extract(_trim(F.regexp_extract(line, r"^([^(]*)\(", 1)), r"(\S+)$", 1), "^`+|`+$", "")
    plain = F.when(before.rlike("[.=]"), "").otherwise(before)
    name = F.when(line.contains("fun "), named).otherwise(plain)
    return F.when(line.contains("(") & ~line.rlike(NOT_METHODS), F.nullif(name, F.lit("")))


def test_units(files: DataFrame) -> DataFrame:
    """path, language, name, parent ('' if none), start_line, end_line: one row a test of Go, Python, JavaScript, TypeScript,
    Java, Kotlin, Ruby, PHP and Rust files. A unit begins at its test (JVM, Rust: at the annotation) and ends before the next
    one, after MOST_UNIT_LINES lines or with the file. Null and empty bodies, other languages and files without tests give no rows."""
    rows = code_lines(files)
    line, lang = F.col("line"), F.col("language")
    js, jvm = lang.isin("javascript", "typescript") & paths.is_test("path"), lang.isin("java", "kotlin")
    call = r"(?:\.only|\.skip)?\(\s*" + QUOTED
    ruby_call = r"(?:\(| )\s*" + QUOTED
    python_class = F.regexp_replace(F.regexp_replace(F.regexp_extract(line, r"^class (Test\S*)", 1), ":$", ""), r"\($", "")
    jvm_class = F.regexp_extract(F.regexp_replace(line, r"\{", " "), r"(?:^|\s)(?:class|interface)\s+[{(<]*([^\s{(<]+)", 1)
    parent = (
        F.when((lang == "python") & line.rlike(r"^class Test.*:"), python_class)
        .when(js, _when_matched(line, "^(?:describe|context)" + call, 2))
        .when(lang == "ruby", _when_matched(line, "^(?:describe|context)" + ruby_call, 2))
        .when(jvm, F.nullif(jvm_class, F.lit("")))
    )
    method, rust = _jvm_method(line), F.nullif(_trim(F.regexp_extract(line, r"^.*?fn ([^(]*)\(", 1)), F.lit(""))
    php = F.nullif(_trim(F.regexp_extract(line, r"^.*?function ([^(]*)\(", 1)), F.lit(""))
    # the line of an annotation that waits for its function; 0 says that none waits any more, null leaves it as it was
    note = (
        F.when(jvm & line.rlike("(?i)^@.*test"), F.col("line_no"))
        .when(jvm & (method.isNull() & line.startswith("@") | (line == "")), None)
        .when((lang == "rust") & line.rlike(r"(?i)^#\[.*test"), F.col("line_no"))
        .when((lang == "rust") & (line.startswith("#[") | (line == "")), None)
        .when((lang == "php") & line.startswith("#[Test"), F.col("line_no"))
        .otherwise(0)
    )
    order = Window.partitionBy("path").orderBy("line_no")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", parent.alias("_parent"), note.alias("_note"), F.max("line_no").over(Window.partitionBy("path")).alias("_last"))
    rows = rows.select("*", F.coalesce(F.last("_note", True).over(before), F.lit(0)).alias("_waits"), F.coalesce(F.last("_parent", True).over(so_far), F.lit("")).alias("parent"))
    waits = F.col("_waits") > 0
    name = (
        F.when(lang == "go", _trim(_when_matched(line, r"^func (Test[^(]*)\(", 1)))
        .when(lang == "python", _trim(_when_matched(line, r"^def (test_[^(]*)\(", 1)))
        .when(js, _when_matched(line, "^(?:it|test)" + call, 2))
        .when(lang == "ruby", _when_matched(line, "^it" + ruby_call, 2))
        .when(jvm & ~line.rlike("(?i)^@.*test") & (waits | F.lower(method).startswith("test")), method)
        .when((lang == "rust") & ~line.startswith("#[") & waits, rust)
        .when((lang == "php") & ~line.startswith("#[Test") & (waits | F.lower(php).startswith("test")), php)
    )
    start = F.when(waits & (jvm | (lang == "rust")), F.col("_waits")).otherwise(F.col("line_no"))
    units = rows.select("path", "language", name.alias("name"), "parent", start.cast("long").alias("start_line"), "_last").where("name IS NOT NULL")
    nxt = F.lead("start_line").over(Window.partitionBy("path").orderBy("start_line"))
    end = F.least(F.coalesce(nxt - 1, F.col("_last")), F.col("start_line") + MOST_UNIT_LINES - 1)
    return units.select("path", "language", "name", "parent", "start_line", end.cast("long").alias("end_line"))


def comment_role(text: Column, start_line: Column) -> Column:
    """Role of a comment by its words; null for comments under 12 bytes, without such words, and for licence headers."""
    t = F.lower(text)
    licence = (start_line <= 40) & _any(t, LICENCE_WORDS) & ~_any(t, KEPT_IN_LICENCES)
    role = F.when((F.octet_length(t) < 12) | licence, None)
    for name, words in COMMENT_ROLES.items():
        role = role.when(_any(t, words), name)
    return role


def intent_comments(files: DataFrame) -> DataFrame:
    """path, language, start_line, end_line, role, text: line comments that follow each other and block comments, if their
    words give them a role. Inside a block only its end counts. Null and empty bodies give no rows."""
    rows = code_lines(files)
    line, lang = F.col("line"), F.col("language")
    order = Window.partitionBy("path").orderBy("line_no")
    opens = line.startswith("/*") & ~F.substring(line, 3, 1_000_000_000).contains("*/")
    event = F.when(opens, True).when(line.contains("*/"), False)
    rows = rows.withColumn("_in", F.coalesce(F.last(event, True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    inside, begins = F.col("_in"), ~F.col("_in") & line.startswith("/*")
    mark = F.when(lang.isin("python", "ruby"), r"^#(?!!)").when(lang == "php", r"^(?://|#)").otherwise("^//")
    single = ~inside & ~begins & F.regexp_like(line, mark)
    kind = F.when(inside | begins, "block").when(single, "line")
    opened = F.when(begins, F.substring(line, 3, 1_000_000_000)).otherwise(line)
    said = F.when(inside | begins, F.regexp_extract(opened, r"(?s)^(.*?)(?:\*/.*)?$", 1)).when(single, F.regexp_replace(line, mark, ""))
    rows = rows.select("path", "language", "line_no", kind.alias("_kind"), begins.alias("_begins"), said.alias("said"))
    first = F.col("_begins") | ((F.col("_kind") == "line") & ~F.lag("_kind").over(order).eqNullSafe("line"))
    rows = rows.withColumn("_unit", F.sum(first.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_kind IS NOT NULL")
    clean = _trim(F.regexp_replace(_trim("said"), r"^\*", ""))
    said_in_order = F.transform(F.array_sort(F.collect_list(F.when(clean != "", F.struct("line_no", clean.alias("said"))))), lambda s: s["said"])
    units = rows.groupBy("path", "language", "_unit").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("_end"), F.array_join(said_in_order, "\n").alias("text"))
    end = F.least(F.col("_end"), F.col("start_line") + MOST_COMMENT_LINES - 1)
    return units.select("path", "language", "start_line", end.alias("end_line"), comment_role(F.col("text"), F.col("start_line")).alias("role"), "text").where("role IS NOT NULL")


def found_names(body: Column | str, patterns: Sequence[str], longest: int = LONGEST_NAME) -> Column:
    """What the patterns' groups match, in the order of the patterns, each value once."""
    all_found = F.concat(*[F.regexp_extract_all(filled(body), F.lit(p), F.lit(1)) for p in patterns])
    return F.array_distinct(F.filter(F.transform(all_found, _trim), lambda v: (v != "") & (F.octet_length(v) <= longest)))


def imports(body: Column | str) -> Column:
    """Imports of a file, those of its own repository first, each part sorted, at most MOST_IMPORTS."""
    values = F.filter(F.array_distinct(F.transform(found_names(body, IMPORTS, 180), lambda v: F.regexp_replace(v, "^[\"'`;]+|[\"'`;]+$", ""))), lambda v: (v != "") & ~v.rlike(r"[ \t\r\n]"))
    local = lambda v: v.rlike(r"^(?:\.|crate::|self::|super::)") | F.lower(F.regexp_extract(v, r"^((?:(?!::)[^/.])*)", 1)).isin(*LOCAL_ROOTS)
    return F.slice(F.concat(F.array_sort(F.filter(values, local)), F.array_sort(F.filter(values, lambda v: ~local(v)))), 1, MOST_IMPORTS)


def path_terms(path: Column | str) -> Column:
    """Lower-cased runs of letters and digits of a path and the base name without its extension, sorted, each once."""
    whole = F.regexp_replace(paths.stem(path), r"^[._\- ]+|[._\- ]+$", "")
    words = F.split(F.lower(filled(path)), r"[^\p{L}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(F.concat(words, F.array(whole)), lambda t: t != "")))


def manifest(files: DataFrame) -> DataFrame:
    """path, language, terms, symbols, tests, imports: what is indexed of each file."""
    return files.select("path", paths.language("path").alias("language"), path_terms("path").alias("terms"), found_names("body", SYMBOLS).alias("symbols"), found_names("body", TEST_NAMES).alias("tests"), imports("body").alias("imports"))
