"""Secret rules as one ordered CASE expression (first matching rule wins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens import rules


def secret_rule_index(line: Column) -> Column:
    """0-based index of the first rule matching `line`, NULL when none does.

    CASE WHEN is evaluated lazily in order, so a line stops at its first hit.
    """
    expr = None
    for i, (_, pattern, _) in enumerate(rules.SECRET_RULES):
        cond = line.rlike(pattern)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


# Literal fragments implied by the rules: a line that matches any rule contains
# at least one of these (case-sensitive ones as written, the case-insensitive
# rules' fragments in the lower-cased line). Used as an exact, cheap prefilter
# so that only candidate lines pay for the regexes.
_CASED_FRAGMENTS = ["AKIA", "ABIA", "ACCA", "ASIA", "-----BEGIN ", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "eyJ", "://"]
_LOWER_FRAGMENTS = ["secret", "api", "passw", "pwd"]


def secret_candidate(line: Column) -> Column:
    """False only for lines no secret rule can match."""
    low = F.lower(line)
    conds = [line.contains(f) for f in _CASED_FRAGMENTS] + [low.contains(f) for f in _LOWER_FRAGMENTS]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _pick(idx: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx + 1)


def secret_rule_name(idx: Column) -> Column:
    return _pick(idx, [name for name, _, _ in rules.SECRET_RULES])


def secret_rule_severity(idx: Column) -> Column:
    return _pick(idx, [sev for _, _, sev in rules.SECRET_RULES])
