"""Imports as edges between files, and what they say about areas.

An import names a path (relative, or from a source root) or a module. A path is looked up with the endings that source
files have; a module that is no path belongs to the one file that ends in its segments, up to SEGMENTS of them; suffixes of
several files give none. All lookups are joins on equal names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

SEGMENTS = 5
# Endings of source files in the order in which they are tried; roots of paths in imports; what an import adds
# to an area that holds both files, how many count, and the same for imports by tests.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".py", ".go", ".rs", ".java", ".kt", ".kts", ".cs")
ROOTS = ("src", "app", "apps", "packages", "libs", "lib", "internal", "pkg")
IMPORT_WEIGHT, MOST_IMPORTS, TEST_WEIGHT, MOST_TEST_IMPORTS = 0.65, 40, 1.4, 16


def cleaned(path: Column) -> Column:
    """A path without . and .. segments; .. above the top stays."""
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
    step = lambda acc, s: F.when(s.isin("", "."), acc).when((s == "..") & F.coalesce(up(acc), F.lit(False)), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def suffix_index(files: DataFrame) -> DataFrame:
    """suffix, path: the last 1 to SEGMENTS segments of paths, with and without the ending, that belong to one file only."""
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    each = F.array_distinct(F.concat(paths.suffixes("path", SEGMENTS), paths.suffixes(bare, SEGMENTS)))
    index = files.select("path", F.explode(each).alias("suffix")).groupBy("suffix").agg(F.min("path").alias("path"), F.max("path").alias("_other"))
    return index.where("path = _other").select("suffix", "path")


def looked_up(path: Column, spec: Column) -> tuple[Column, Column]:
    """What an import in a file asks for: a path, and a module to be found by its suffix (null if it is a path)."""
    folder = paths.directory(path)
    rust = lambda s: F.trim(F.regexp_extract(F.regexp_replace(F.replace(s, F.lit("::"), F.lit("/")), "[{}]", ""), "^([^,]*)", 1))
    plain = F.regexp_replace(F.when(spec.startswith("@"), F.regexp_replace(spec, "^@(?:[^/]*/)?", "")).otherwise(spec), r"\.|::", "/")
    in_crate = spec.rlike("^(?:crate|self)::")
    is_path = spec.rlike(rf"^(?:\.|[@~]/|super::|(?:{'|'.join(ROOTS)})/)")
    asked = (
        F.when(spec.startswith("."), cleaned(F.concat_ws("/", folder, spec)))
        .when(spec.rlike("^[@~]/"), F.expr("substring(spec, 3)"))
        .when(in_crate, rust(F.regexp_replace(spec, "^(?:crate::)?(?:self::)?", "")))
        .when(spec.startswith("super::"), cleaned(F.concat_ws("/", folder, F.lit(".."), rust(F.regexp_replace(spec, "^super::", "")))))
        .when(is_path, spec)
        .otherwise(plain)
    )
    return cleaned(asked), F.when(~is_path, cleaned(asked))


def resolved(files: DataFrame, specs: DataFrame) -> DataFrame:
    """path, spec, target of the imports specs (path, spec) that name another file of files (path)."""
    asked, module = looked_up(F.col("path"), F.trim("spec"))
    want = specs.select("path", F.trim("spec").alias("spec")).distinct().select("path", "spec", asked.alias("asked"), module.alias("module")).where("asked != ''")
    ends = ["", *ENDINGS, *[f"/index{e}" for e in ENDINGS], "/__init__.py"]
    # the few endings that a file has are taken off, instead of all being tried on each import
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(e).alias("end")) for i, e in enumerate(ends)])
    known = files.select(F.col("path").alias("target")).select("target", F.explode(F.filter(turns, lambda t: F.endswith("target", t["end"]))).alias("t"))
    known = known.select("target", "t.turn", F.expr("left(target, length(target) - length(t.end))").alias("asked")).where("asked != ''")
    # all sides grow with the files, which the size of the table they come from does not tell: none is ever sent whole
    exact = want.join(known.hint("merge"), "asked").groupBy("path", "spec").agg(F.min_by("target", "turn").alias("target"))
    rest = want.where("module IS NOT NULL").join(exact.hint("merge"), ["path", "spec"], "left_anti")
    by_suffix = rest.join(suffix_index(files).select(F.col("suffix").alias("module"), F.col("path").alias("target")).hint("merge"), "module").select("path", "spec", "target")
    return exact.unionByName(by_suffix).where("target != path")


def evidence(edges: DataFrame, members: DataFrame) -> DataFrame:
    """area, imports, test_imports, score for edges (path, target) between files of one area (members: area, path)."""
    both = edges.join(members.hint("merge"), "path").join(members.select("area", F.col("path").alias("target")).hint("merge"), ["area", "target"])
    by_test = paths.is_test("path") & ~paths.is_test("target")
    n = both.groupBy("area").agg(F.count("*").alias("imports"), F.count_if(by_test).alias("test_imports"))
    score = IMPORT_WEIGHT * F.least("imports", F.lit(MOST_IMPORTS)) + TEST_WEIGHT * F.least("test_imports", F.lit(MOST_TEST_IMPORTS))
    return n.withColumn("score", F.round(score, 6))
