"""Severity rank / weight, score grades, colours and heat as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revline.schema import SEVERITIES, SEVERITY_WEIGHTS, UNKNOWN_SEVERITY_RANK

# --- fixed values: grade cut-offs (score >= cut gives the grade, checked top down) ---
# Root scale: 90 A+, 85 A, 80 B+, 75 B, 65 C, otherwise F.
GRADES_ROOT = [(90, "A+"), (85, "A"), (80, "B+"), (75, "B"), (65, "C")]
# src scale: 90 A+, 80 B, 70 C, 60 D, otherwise F.
GRADES_SRC = [(90, "A+"), (80, "B"), (70, "C"), (60, "D")]
FAIL_GRADE = "F"
# Heat: fewer than 5 findings LOW, fewer than 15 MED, otherwise HIGH.
HEAT_CUTS = [(5, "LOW"), (15, "MED")]
HEAT_TOP = "HIGH"
# -------------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def severity_rank(sev="severity") -> Column:
    """critical 0 … info 4; a missing (null) severity counts as info; anything else 5."""
    s = _col(sev)
    expr = F.when(s.isNull(), F.lit(SEVERITIES.index("info")))
    for i, name in enumerate(SEVERITIES):
        expr = expr.when(s == name, F.lit(i))
    return expr.otherwise(F.lit(UNKNOWN_SEVERITY_RANK))


def severity_weight(sev="severity") -> Column:
    s = _col(sev)
    expr = None
    for name, w in SEVERITY_WEIGHTS.items():
        expr = F.when(s == name, F.lit(w)) if expr is None else expr.when(s == name, F.lit(w))
    return expr.otherwise(F.lit(0))


def grade(score="score", scale: str = "root") -> Column:
    cuts = {"root": GRADES_ROOT, "src": GRADES_SRC}[scale]
    s = _col(score)
    expr = None
    for cut, g in cuts:
        expr = F.when(s >= cut, F.lit(g)) if expr is None else expr.when(s >= cut, F.lit(g))
    return expr.otherwise(F.lit(FAIL_GRADE))


def grade_colour(g="grade") -> Column:
    """Contains 'A' → green, else contains 'B' → yellow, else red (so 'N/A' is green)."""
    s = _col(g)
    return (F.when(s.contains("A"), F.lit("green"))
            .when(s.contains("B"), F.lit("yellow"))
            .otherwise(F.lit("red")))


def heat(n="n") -> Column:
    s = _col(n)
    expr = None
    for cut, label in HEAT_CUTS:
        expr = F.when(s < cut, F.lit(label)) if expr is None else expr.when(s < cut, F.lit(label))
    return expr.otherwise(F.lit(HEAT_TOP))


def meets_threshold(sev="severity", threshold="severity_threshold") -> Column:
    """Keep a finding when its rank is at or above the threshold's rank.

    Severities outside the domain (rank 5) survive only a threshold of ``info``.
    """
    r = severity_rank(sev)
    t = severity_rank(threshold)
    return (r <= t) | ((r == UNKNOWN_SEVERITY_RANK) & (t == SEVERITIES.index("info")))
