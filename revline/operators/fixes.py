"""Fix gate, fix candidates with a syntax check, approvals, test stubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revline.operators.facts import syntax_ok_udf

# --- fixed values: templates of the generated fix and of the adversarial test stub ------------
FIX_TEMPLATE = "# Fixed %s\ndef fixed_function():\n    pass"
FIX_STATUS = "valid_syntax"
FIX_ERROR = "LLM generated invalid syntax for issue %s"
TEST_STUB_TEMPLATE = ("\nimport pytest\nfrom %s import ...\n\ndef test_adversarial_logic():\n"
                      "    # Automatically generated to test: %s\n    assert True\n")
URGENT_SEVERITIES = ["critical", "high"]
SAFE_SEVERITIES = ["low", "info"]
# ------------------------------------------------------------------------------------------------


def fix_gate(findings: DataFrame, config: DataFrame) -> DataFrame:
    """E14 (root): fixes when enabled and some critical/high finding is auto-fixable.
    E15 (src): fixes whenever enabled. ``config`` has repo_id and an ``auto_fix`` struct."""
    urgent = findings.groupBy("repo_id").agg(
        F.bool_or(F.col("severity").isin(URGENT_SEVERITIES) & F.col("auto_fixable")).alias("has_urgent_fixable"))
    enabled = F.coalesce(F.col("auto_fix.enabled"), F.lit(False))
    return config.join(urgent, "repo_id", "left").select(
        "repo_id",
        F.when(enabled & F.coalesce("has_urgent_fixable", F.lit(False)), F.lit("generate_fixes"))
        .otherwise(F.lit("skip_fixes")).alias("decision_root"),
        F.when(enabled, F.lit("generate_fixes")).otherwise(F.lit("skip_fixes")).alias("decision_src"))


def fix_candidates(findings: DataFrame, fix_col: str | None = None) -> DataFrame:
    """E16 input: every auto-fixable finding with its fix text and whether that text parses.

    The fix text is the reference's template unless the caller supplies a ``fix_col``.
    """
    fixable = findings.filter(F.col("auto_fixable"))
    if fix_col:
        ok = syntax_ok_udf()
        return fixable.select(F.col("id").alias("issue_id"), "repo_id", "severity", F.col(fix_col).alias("fix_code")) \
            .withColumn("valid", ok(F.col("fix_code")))
    # Template fixes: the title sits in a comment line, so the text parses unless the title
    # breaks the line (CR, LF) or holds a NUL. Only those rows reach the Python parser.
    title = F.coalesce("title", F.lit("None"))
    needs_parse = title.rlike("[\\r\\n\\x00]")
    ok = syntax_ok_udf(null_passes=True)
    return fixable.select(F.col("id").alias("issue_id"), "repo_id", "severity",
                          F.format_string(FIX_TEMPLATE, title).alias("fix_code"), needs_parse.alias("_p")) \
        .withColumn("valid", F.coalesce(ok(F.when(F.col("_p"), F.col("fix_code"))), F.lit(True))).drop("_p")


def valid_fixes(candidates: DataFrame) -> DataFrame:
    """(issue_id, fix_code, status) for fixes that parse."""
    return candidates.filter(F.col("valid")).select("repo_id", "issue_id", "fix_code", F.lit(FIX_STATUS).alias("status"))


def fix_errors(candidates: DataFrame) -> DataFrame:
    """The error message for every fix that does not parse."""
    return candidates.filter(~F.col("valid")).select(
        "repo_id", "issue_id", F.format_string(FIX_ERROR, F.col("issue_id")).alias("error"))


def approved(fixes: DataFrame, approvals: DataFrame) -> DataFrame:
    """Fixes a reviewer approved (semi-join on issue id)."""
    return fixes.join(approvals.select("issue_id").distinct(), "issue_id", "left_semi")


def safe_only(candidates: DataFrame, config: DataFrame) -> DataFrame:
    """With ``auto_fix.safe_only`` on, keep fixes of low/info findings only."""
    cfg = config.select("repo_id", F.coalesce(F.col("auto_fix.safe_only"), F.lit(False)).alias("_safe"))
    return candidates.join(cfg, "repo_id", "left") \
        .filter(~F.coalesce("_safe", F.lit(False)) | F.col("severity").isin(SAFE_SEVERITIES)).drop("_safe")


def module_name(path) -> F.Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.replace(F.replace(p, F.lit(".py"), F.lit("")), F.lit("/"), F.lit("."))


def test_stubs(findings: DataFrame) -> DataFrame:
    """One adversarial test stub per finding, importing the file's module."""
    return findings.select("id", "file", F.format_string(TEST_STUB_TEMPLATE, module_name("file"),
                                                          F.col("description")).alias("test_code"))


def issue_payloads(findings: DataFrame) -> DataFrame:
    """Issue title, body and labels per finding (posting them is not built)."""
    return findings.select("id", "repo_id", "title", F.col("description").alias("body"),
                           F.array("severity", "category").alias("labels"))
