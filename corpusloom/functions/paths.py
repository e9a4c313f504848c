"""Path functions as Spark columns; paths use forward slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Languages by file extension.
LANGUAGES = {"go": "go", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "rs": "rust", "sql": "sql", "md": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json", "sh": "shell"}


def base(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def directory(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(base(path), r"\.([^.]+)$", 1))


def stem(path: Column | str) -> Column:
    """Base name without extension, lower-cased."""
    return F.lower(F.regexp_replace(base(path), r"\.[^.]+$", ""))


def source_stem(path: Column | str) -> Column:
    """Stem of the source that a test file belongs to by its name."""
    return F.regexp_replace(stem(path), r"^test[_-]|[._-](?:test|spec|tests)$", "")


def depth(path: Column | str) -> Column:
    return F.size(F.split(col(path), "/")).cast("long")


def ancestors(path: Column | str) -> Column:
    """All directories above a path, outermost first."""
    parts = F.split(col(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def suffixes(path: Column | str, most: int = 5) -> Column:
    """The path's last 1 to ``most`` segments."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "/"))


def language(path: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("other"))


def is_test(path: Column | str) -> Column:
    return col(path).rlike(r"(^|/)(tests?|spec|__tests__)/|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*$")


def is_source(path: Column | str) -> Column:
    return extension(path).isin(*[k for k, v in LANGUAGES.items() if v not in ("markdown", "yaml", "json")]) & ~is_test(path)


def is_noise(path: Column | str) -> Column:
    return col(path).rlike(r"(^|/)(vendor|node_modules|dist|build|generated|archive|\.git)/|\.(lock|min\.js|map)$|(^|/)(package-lock\.json|go\.sum)$")


def path_class(path: Column | str) -> Column:
    p = col(path)
    return (
        F.when(p.rlike(r"(^|/)(archive|archived)/"), "archive").when(is_noise(p), "noise").when(is_test(p), "test").when(is_source(p), "source").when(p.rlike(r"(^|/)(docs?|plans?|adr|rfcs?|prd)/"), "planning").otherwise("other")
    )
