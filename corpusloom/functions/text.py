"""Text functions as Spark columns: tokens, identifiers, concepts, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"
# Words that carry no topic.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "into", "are", "was", "how", "what")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: Column | str) -> Column:
    """NULL reads as the empty string at the boundary of the model."""
    return F.coalesce(col(c), F.lit(""))


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(filled(c)), NOT_WORD), lambda t: t != "")


def normalized(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(filled(c)), NOT_WORD, " "))


def identifier_parts(c: Column | str) -> Column:
    """Identifier cut at _ - . / and at changes from lower to upper case; lower-cased, first occurrences."""
    spaced = F.regexp_replace(filled(c), r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), r"[\s_./-]+"), lambda t: t != ""))


def query_terms(c: Column | str, least: int = 3, most: int = 12, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Search terms: letters, digits and _ - . kept, at least three bytes, no stop words, each once, the first twelve."""
    raw = F.regexp_extract_all(F.lower(filled(c)), F.lit(r"[\p{L}\p{N}_.-]+"), F.lit(0))
    kept = F.filter(F.array_distinct(raw), lambda t: (F.octet_length(t) >= least) & ~t.isin(*stop))
    return F.slice(kept, 1, most)


def ngrams(words: Column, n: int) -> Column:
    """Phrases of n words in a row."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def token_estimate(c: Column | str) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(filled(c)) + 3) / 4).cast("long")


def occurrences(c: Column | str, term: str, most: int | None = None) -> Column:
    """Non-overlapping occurrences of a substring, capped."""
    n = ((F.octet_length(col(c)) - F.octet_length(F.replace(col(c), F.lit(term), F.lit("")))) / F.octet_length(F.lit(term))).cast("long")
    return n if most is None else F.least(n, F.lit(most).cast("long"))


def derived_id(prefix: str, digits: int, *parts: Column) -> Column:
    """Reproducible id: hex digits of the sha256 over the parts joined by NUL."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits))


def content_hash(c: Column | str) -> Column:
    """sha256 of a body after line ends and blanks before them are made uniform."""
    return F.sha2(F.regexp_replace(F.replace(filled(c), F.lit("\r\n"), F.lit("\n")), r"[ \t]+(?=\n|\z)", ""), 256)


def shortened(c: Column | str, most: int) -> Column:
    """At most so many characters, with an ellipsis where cut."""
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most - 1), F.lit("…"))).otherwise(col(c))


def clamped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def glob_regex(pattern: str) -> str:
    """A glob with ** (any depth), * (within a segment) and ? as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + pattern[i] if pattern[i] in ".+()[]{}^$|\\" else pattern[i]), i + 1
    return f"^{out}$"


def glob_matches(path: Column | str, pattern: str) -> Column:
    return col(path).rlike(glob_regex(pattern))
