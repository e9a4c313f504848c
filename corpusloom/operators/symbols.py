"""References of texts to the symbols of source files.

Symbols are a dictionary of compact names (letters and digits, lower-cased); one that more than MOST_SOURCES files define is
no reference. Tokens of texts that look like identifiers are looked up in it by a join on the compact name, so no text is
searched for each symbol, and what is shuffled are tokens that name a symbol. Caps per text and per source are filled in the
order of texts, symbols and sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled
from .candidates import _name_parts
from .greedy import greedy_first, slot

# Files of a symbol, references of a text and to a source, and all, at most; weight and confidence of an edge;
# words that name no symbol; what a token looks like.
MOST_SOURCES, MOST_OF_TEXT, MOST_TO_SOURCE, MOST_EDGES, WEIGHT, CONFIDENCE = 4, 8, 24, 1200, 0.78, 0.82
NO_SYMBOLS = ("body", "common", "config", "error", "errors", "file", "files", "fixture", "fixtures", "helper", "helpers", "index", "main", "name", "parse", "path", "result", "setup", "shared", "source", "spec", "status", "target", "test", "tests", "title", "types", "util", "utils", "value", "values")
TOKEN = r"[A-Za-z_$][A-Za-z0-9_$]*(?:[._-][A-Za-z0-9_$]+)*"
LONG_WORD = 12


def compact_name(c: Column) -> Column:
    return F.array_join(_name_parts(c), "")


def useful(name: Column) -> Column:
    return (F.octet_length(name) >= 4) & ~name.isin(*NO_SYMBOLS)


def specific(token: Column) -> Column:
    """Tokens that look like identifiers: with a mark, a digit or a capital inside, or long."""
    n = F.octet_length(token)
    return n.between(4, 96) & (token.rlike(r"[_\-.$0-9]|[a-z0-9][A-Z]") | (n >= LONG_WORD))


def dictionary(files: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """name, form, source, path for the useful symbols of files (source, path, symbols) that ``most`` files define at most."""
    each = files.select("source", "path", F.explode("symbols").alias("form")).withColumn("name", compact_name(F.col("form"))).where(useful(F.col("name")))
    each = each.groupBy("name", "source").agg(F.first("path").alias("path"), F.min("form").alias("form"))
    few = each.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("name")
    return each.join(few, "name")


def references(texts: DataFrame, files: DataFrame) -> DataFrame:
    """ref, source, name, form, path: symbols that texts (ref, title, body) name in whole titles and bodies; uncapped."""
    tokens = F.regexp_extract_all(F.concat_ws("\n", filled("title"), filled("body")), F.lit(TOKEN), F.lit(0))
    trimmed = F.array_distinct(F.transform(tokens, lambda t: F.regexp_replace(t, r"^[_.$]+|[_.$]+$", "")))
    # named inside the array, where a name that is tested and returned is made once
    named = F.transform(F.filter(trimmed, specific), lambda t: F.struct(t.alias("form"), compact_name(t).alias("name")))
    said = texts.select("ref", F.explode(F.filter(named, lambda x: useful(x["name"]))).alias("x")).select("ref", "x.form", "x.name")
    known = dictionary(files)
    met = said.join(known.select("name", "source", "path"), "name").where("ref != source")
    return met.groupBy("ref", "source", "name").agg(F.min("form").alias("form"), F.first("path").alias("path"))


def reference_edges(texts: DataFrame, files: DataFrame, of_text: int = MOST_OF_TEXT, to_source: int = MOST_TO_SOURCE, most: int = MOST_EDGES) -> DataFrame:
    """references within the caps, the first ``most`` of them by text, symbol and path, with weight and confidence."""
    order = [F.col(c) for c in ("ref", "name", "path", "source")]
    kept = greedy_first(references(texts, files), order, [slot("text", of_text, "ref"), slot("source", to_source, "source")], most)
    return kept.withColumn("weight", F.lit(WEIGHT)).withColumn("confidence", F.lit(CONFIDENCE))
