"""Reports as ordered line rows ``(repo_id, pos, text)``.

A report per repository is the concatenation of its rows by ``pos``. Keeping one row per finding
(instead of one string per repository) means a repository with a billion findings is written by
many tasks in order (``sources.sinks.write_report``), never gathered into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revline.operators.ordering import group_sizes, positions
from revline.operators.synthesis import prioritize

# --- fixed values: report templates and fallbacks (the script reports' product-named headings are
#     replaced by neutral ones) ------------------------------------------------------------------------
MD_HEADER = "# Code Review Report\n\n"
MD_EMPTY = "No issues found."
MD_ITEM = "## %s\n- **Severity**: %s\n- **File**: %s\n- **Description**: %s\n\n"
MD_DEFAULTS = {"title": "Issue", "severity": "Info", "file": "N/A", "description": ""}
JSON_OPEN = '{"findings": ['
JSON_CLOSE = '], "summary": "Analysis complete"}'
BOOT_HEADER = "# Review Report\n\n## Findings\n"
BOOT_ITEM = "### %s (%s)\n- **File**: %s\n- **Description**: %s\n\n"
FULL_HEADER = ("# Full Review Report\nDate: %s\n\n## Summary\n- Total Findings: %d\n"
               "- Critical: %d\n- High: %d\n- Medium: %d\n- Low: %d\n\n## Detailed Findings\n")
FULL_ITEM = "### %s [%s]\n- File: %s\n- Description: %s\n\n"
# Finding keys in the reference's record order (JSON report).
JSON_FIELDS = ["id", "file", "line", "column", "severity", "category", "title", "description", "impact",
               "recommendation", "code_snippet", "suggested_fix", "auto_fixable", "references", "cwe_id",
               "cvss_score"]
# ---------------------------------------------------------------------------------------------------


def _repos(findings: DataFrame, repos: DataFrame | None) -> DataFrame:
    return (repos if repos is not None else findings).select("repo_id").distinct()


def _md(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(MD_DEFAULTS[c]))


def markdown_lines(findings: DataFrame, repos: DataFrame | None = None, mode: str = "rank") -> DataFrame:
    """header, then one block per finding in priority order, or ``No issues found.``"""
    items = prioritize(findings, mode, "pos").select(
        "repo_id", "pos", F.format_string(MD_ITEM, _md("title"), _md("severity"), _md("file"),
                                          _md("description")).alias("text"))
    all_repos = _repos(findings, repos)
    header = all_repos.select("repo_id", F.lit(0).cast("long").alias("pos"), F.lit(MD_HEADER).alias("text"))
    # distinct first: partial aggregation collapses a hot repo before the anti-join shuffle
    empty = all_repos.join(findings.select("repo_id").distinct(), "repo_id", "left_anti") \
        .select("repo_id", F.lit(1).cast("long").alias("pos"), F.lit(MD_EMPTY).alias("text"))
    return header.unionByName(empty).unionByName(items)


def json_lines(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """``{"findings": [...], "summary": "Analysis complete"}`` split into one row per finding."""
    pri = prioritize(findings.where("repo_id is not null"), "rank", "pos", "_n")  # positions tell the size: no second join of the findings
    sizes = group_sizes(findings, "repo_id", "_n")
    obj = F.to_json(F.struct(*[F.col(c) for c in JSON_FIELDS if c in findings.columns]))
    items = pri.select(
        "repo_id", "pos", F.concat(obj, F.when(F.col("pos") < F.col("_n"), F.lit(",")).otherwise(F.lit(""))).alias("text"))
    all_repos = _repos(findings, repos).join(sizes, "repo_id", "left")
    head = all_repos.select("repo_id", F.lit(0).cast("long").alias("pos"), F.lit(JSON_OPEN).alias("text"))
    tail = all_repos.select("repo_id", (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("pos"),
                            F.lit(JSON_CLOSE).alias("text"))
    return head.unionByName(items).unionByName(tail)


def bootstrap_lines(findings: DataFrame) -> DataFrame:
    """the bootstrap script's report, findings in insertion order (stage, then seq)."""
    items = positions(findings, "repo_id", ["stage_order", "seq", "id"], "pos", ["stage_order", F.floor(F.col("seq") / 1024)],
                      ["seq", "id"]).select(
        "repo_id", "pos", F.format_string(BOOT_ITEM, F.col("title"), F.upper("severity"), F.col("file"),
                                          F.col("description")).alias("text"))
    header = findings.select("repo_id").distinct().select(
        "repo_id", F.lit(0).cast("long").alias("pos"), F.lit(BOOT_HEADER).alias("text"))
    return header.unionByName(items)


def full_phase_lines(findings: DataFrame, run_date: str) -> DataFrame:
    """summary block with real counts (the reference prints fixed ones), then findings sorted
    by the severity string."""
    counts = findings.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s)
                                        for s in ("critical", "high", "medium", "low")])
    header = counts.select("repo_id", F.lit(0).cast("long").alias("pos"), F.format_string(
        FULL_HEADER, F.lit(run_date), "n", "critical", "high", "medium", "low").alias("text"))
    items = prioritize(findings, "alpha", "pos").select(
        "repo_id", "pos", F.format_string(FULL_ITEM, F.col("title"), F.upper("severity"), F.col("file"),
                                          F.col("description")).alias("text"))
    return header.unionByName(items)
