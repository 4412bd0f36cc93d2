"""Data model: the findings table and the fixed domains the reference uses."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference's for matching results) -----------
# Severity domain in priority order: critical, high, medium, low, info.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
# Score penalty per severity: critical 20, high 10, medium 5, low 2, anything else 0.
SEVERITY_WEIGHTS = {"critical": 20, "high": 10, "medium": 5, "low": 2}
# Rank used for prioritisation; severities outside the domain rank 5.
UNKNOWN_SEVERITY_RANK = 5
# Finding stages in the order the reference concatenates them:
# static, pattern, security, performance, testing, logic, policy.
STAGES = ["static", "pattern", "security", "performance", "testing", "logic", "policy"]
# Stages shown in the category-heat summary (testing and policy are not shown):
# Static, Pattern, Security, Performance, Logic.
HEAT_STAGES = ["static", "pattern", "security", "performance", "logic"]
# --------------------------------------------------------------------------------

STAGE_ORDER = {s: i for i, s in enumerate(STAGES)}

FINDING_FIELDS = [
    ("repo_id", T.StringType()),
    ("id", T.StringType()),
    ("file", T.StringType()),
    ("line", T.IntegerType()),
    ("column", T.IntegerType()),
    ("severity", T.StringType()),
    ("category", T.StringType()),
    ("title", T.StringType()),
    ("description", T.StringType()),
    ("impact", T.StringType()),
    ("recommendation", T.StringType()),
    ("code_snippet", T.StringType()),
    ("suggested_fix", T.StringType()),
    ("auto_fixable", T.BooleanType()),
    ("references", T.ArrayType(T.StringType())),
    ("cwe_id", T.StringType()),
    ("cvss_score", T.DoubleType()),
    ("stage", T.StringType()),
    ("stage_order", T.IntegerType()),
    ("seq", T.LongType()),
]
FINDINGS_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in FINDING_FIELDS])
FINDING_COLUMNS = [n for n, _ in FINDING_FIELDS]

SOURCE_FILES_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
])
