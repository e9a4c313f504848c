"""Declarative classification: rules as data, compiled to columns; weighted models; a resolver with ties and ambiguity."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, glob_regex

REJECT, AMBIGUOUS, CLEAR, GAP = 0.35, 0.55, 0.75, 0.15


@dataclass(frozen=True)
class Rule:
    """All given predicates must hold; a rule without one never matches."""

    weight: float
    path_glob: tuple[str, ...] = ()
    path_contains: tuple[str, ...] = ()
    title_contains: tuple[str, ...] = ()
    body_contains: tuple[str, ...] = ()
    body_regex: str = ""
    body_any: tuple[str, ...] = ()
    least_bytes: int = 0
    kind: tuple[str, ...] = ()

    def column(self) -> Column:
        path, title, body = F.lower(filled("path")), F.lower(filled("title")), F.lower(filled("body"))
        every = [path.rlike("|".join(map(glob_regex, self.path_glob)))] if self.path_glob else []
        every += [path.contains(x) for x in self.path_contains] + [title.contains(x) for x in self.title_contains] + [body.contains(x) for x in self.body_contains]
        if self.body_any:
            every.append(reduce(lambda a, b: a | b, (body.contains(x) for x in self.body_any)))
        if self.body_regex:
            every.append(body.rlike(self.body_regex))
        if self.least_bytes:
            every.append(F.octet_length(filled("body")) >= self.least_bytes)
        if self.kind:
            every.append(F.col("kind").isin(*self.kind))
        return reduce(lambda a, b: a & b, every) if every else F.lit(False)


@dataclass(frozen=True)
class Model:
    name: str
    prior: tuple[Rule, ...] = ()
    positive: tuple[Rule, ...] = ()
    negative: tuple[Rule, ...] = ()
    families: dict[str, tuple[Rule, ...]] = field(default_factory=dict)

    def score(self) -> Column:
        total = F.lit(0.0)
        for sign, rules in ((1, self.prior + self.positive), (-1, self.negative)):
            for r in rules:
                total = total + F.when(r.column(), F.lit(sign * r.weight)).otherwise(F.lit(0.0))
        best = [sum((F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in rules), F.lit(0.0)) for rules in self.families.values()]
        if best:
            total = total + (F.greatest(*best) if len(best) > 1 else best[0])
        return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 3)


def classified(docs: DataFrame, models: list[Model], key: str) -> DataFrame:
    """key, classifier, confidence, second, ambiguous, indexed: best model by confidence, ties by name."""
    scores = F.array(*[F.struct((-m.score()).alias("s"), F.lit(m.name).alias("m")) for m in models])
    ranked = docs.select(key, F.array_sort(scores).alias("r"))
    first, second = F.col("r")[0], F.col("r")[1] if len(models) > 1 else F.struct(F.lit(0.0).alias("s"), F.lit("").alias("m"))
    top, gap = -first["s"], second["s"] - first["s"]
    return ranked.select(
        key,
        F.when(top < REJECT, "none").otherwise(first["m"]).alias("classifier"),
        (top + 0.0).alias("confidence"),
        second["m"].alias("second"),
        ((top < AMBIGUOUS) | ((top < CLEAR) & (F.round(gap, 3) < GAP))).alias("ambiguous"),
        (top >= REJECT).alias("indexed"),
    )
