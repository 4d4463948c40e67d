"""Data-quality rules: warn, drop, fail and quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import QualityError, SpecError

ACTIONS = ("warn", "drop", "fail", "quarantine")
FLAG, IDS, REASONS = "_eng_quarantined", "_eng_failed_rules", "_eng_failure_reasons"


@dataclass(frozen=True)
class Rule:
    id: str
    expression: str
    action: str
    reason: str = ""

    def __post_init__(self):
        if not self.id or not self.expression or self.action not in ACTIONS:
            raise SpecError(f"rule {self.id or '?'}: needs an id, an expression and an action of {ACTIONS}")


def of(rules: Sequence[Rule], action: str) -> list[Rule]:
    return [r for r in rules if r.action == action]


def passes(rule: Rule):
    """Only TRUE passes; null does not."""
    return F.coalesce(F.expr(rule.expression), F.lit(False))


def warn_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per warn rule: rule_id, rows, violations; one pass over df."""
    chosen = of(rules, "warn")
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~passes(r)).alias(f"v{i}") for i, r in enumerate(chosen)])
    each = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.col("rows"), F.col(f"v{i}").alias("violations")) for i, r in enumerate(chosen)])
    return counts.select(F.explode(each).alias("x")).select("x.*")


def observe(df: DataFrame, rules: Sequence[Rule], name: str) -> tuple[DataFrame, Observation]:
    """df with violation counts taken on the way, at no extra pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(~passes(r)).alias(r.id) for r in of(rules, "warn")]), seen


def apply_native(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Drops rows that violate a drop rule; a row that violates a fail rule fails the query that reads it."""
    for r in of(rules, "drop"):
        df = df.filter(passes(r))
    for r in of(rules, "fail"):
        df = df.filter(F.when(passes(r), True).otherwise(F.raise_error(F.lit(f"rule {r.id} violated: {r.expression}")).cast("boolean")))
    return df


def check_fail(df: DataFrame, rules: Sequence[Rule]) -> None:
    """Raises before anything is written, naming every violated fail rule."""
    chosen = of(rules, "fail")
    if chosen:
        found = df.agg(*[F.count_if(~passes(r)).alias(r.id) for r in chosen]).first().asDict()
        if bad := {k: n for k, n in found.items() if n}:
            raise QualityError(f"rules violated (rows): {bad}")


def with_quarantine(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Failed rule ids, reasons and flag; a null predicate does not quarantine, and the columns exist without rules."""
    chosen = of(rules, "quarantine")

    def collect(text):
        hit = [F.when(~F.expr(r.expression), F.lit(text(r))) for r in chosen]
        return F.array_distinct(F.array_compact(F.array(*hit))) if hit else F.array().cast("array<string>")

    df = df.withColumns({IDS: collect(lambda r: r.id), REASONS: collect(lambda r: r.reason or r.expression)})
    return df.withColumn(FLAG, F.size(IDS) > 0)


def clean(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(FLAG)).drop(FLAG, IDS, REASONS)


def quarantined(df: DataFrame) -> DataFrame:
    return df.filter(F.col(FLAG)).withColumn("_eng_validated_at", F.current_timestamp())
