"""Tool reports (linter JSON, complexity JSON) ingested as rows.

Failures are rows too: a report that is an ``{"error": ...}`` object goes to the errors output
instead of failing the job or silently vanishing (T4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revline.operators.detectors import COMPLEXITY_LIMIT, COMPLEXITY_MESSAGE, COMPLEXITY_TITLE, complete_findings

# --- fixed values: lint findings (title prefix, category, defaults for missing keys) -------------
LINT_TITLE_PREFIX = "Lint Issue: "
LINT_CATEGORY = "style"
LINT_DEFAULT_LINE = 0
LINT_DEFAULT_SEVERITY = "medium"
# --------------------------------------------------------------------------------------------------

LINT_ISSUE = ("array<struct<path:string,line:int,column:int,type:string,message:string,"
              "`message-id`:string,symbol:string>>")
COMPLEXITY_BLOCKS = "array<struct<name:string,lineno:int,complexity:int,type:string>>"


def ingest_lint(reports: DataFrame, report_col: str = "report") -> DataFrame:
    """``(path, report)`` → one row per issue with the 7 kept keys renamed; failure → error row.

    Output: path, file, line, column, severity, message, message_id, symbol, error.
    """
    err = F.get_json_object(F.col(report_col), "$.error")
    is_list = F.coalesce(F.trim(F.col(report_col)).startswith("["), F.lit(False))
    issues = F.when(is_list, F.from_json(F.col(report_col), LINT_ISSUE))
    # anything but a readable list is a failure: an error object, broken JSON, or no report at all
    is_obj = ~is_list | issues.isNull() | F.coalesce(F.exists(issues, lambda i: i.isNull()), F.lit(False)) \
        | F.try_parse_json(F.col(report_col)).isNull()
    keep = [c for c in reports.columns if c != report_col]
    ok = reports.filter(~is_obj).select(*keep, F.explode(issues).alias("i")).select(
        *keep, F.col("i.path").alias("file"), F.col("i.line").alias("line"), F.col("i.column").alias("column"),
        F.col("i.type").alias("severity"), F.col("i.message").alias("message"),
        F.col("i.`message-id`").alias("message_id"), F.col("i.symbol").alias("symbol"),
        F.lit(None).cast("string").alias("error"))
    failed = reports.filter(is_obj).select(
        *keep, F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"),
        F.lit(None).cast("int").alias("column"), F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("message_id"),
        F.lit(None).cast("string").alias("symbol"), F.coalesce(err, F.lit("unreadable report")).alias("error"))
    return ok.unionByName(failed)


def lint_findings(issues: DataFrame, strict_parity: bool = False) -> DataFrame:
    """Issue → style finding titled ``Lint Issue: <symbol>``; line 0 and severity medium
    when missing. Failure records become findings only with ``strict_parity`` (the reference's
    ``Lint Issue: None``); otherwise they belong to the errors output."""
    src = issues if strict_parity else issues.filter(F.col("error").isNull())
    df = src.select(
        F.lit(None).cast("string").alias("repo_id") if "repo_id" not in src.columns else F.col("repo_id"),
        F.col("path").alias("file"),
        F.coalesce("line", F.lit(LINT_DEFAULT_LINE)).alias("line"),
        F.coalesce("severity", F.lit(LINT_DEFAULT_SEVERITY)).alias("severity"),
        F.lit(LINT_CATEGORY).alias("category"),
        F.concat(F.lit(LINT_TITLE_PREFIX), F.coalesce("symbol", F.lit("None"))).alias("title"),
        F.coalesce("message", F.lit("")).alias("description"),
        F.col("column"),
        F.lit(False).alias("auto_fixable"),
        F.lit("static").alias("stage"), F.lit(0).alias("stage_order"),
        F.coalesce("line", F.lit(0)).cast("long").alias("seq"))
    return complete_findings(df)


def lint_errors(issues: DataFrame) -> DataFrame:
    keys = [c for c in ("repo_id", "path") if c in issues.columns]
    return issues.filter(F.col("error").isNotNull()).select(*keys, "error")


def ingest_complexity(reports: DataFrame, report_col: str = "report") -> DataFrame:
    """A4: a JSON map path → blocks; keep the entry of the file itself (``path``).

    Parsed to ``map<string,string>`` first, so one failed entry (an object, not a list) cannot
    null the whole document. Output: path, name, lineno, complexity, error.
    """
    m = F.from_json(F.col(report_col), "map<string,string>")
    entry = F.element_at(m, F.col("path"))
    keep = [c for c in reports.columns if c != report_col]
    unread = F.coalesce(F.try_parse_json(F.col(report_col)).isNull(), F.lit(True))
    df = reports.select(*keep, entry.alias("_v"), unread.alias("_unread"))
    is_err = F.get_json_object(F.col("_v"), "$.error").isNotNull() | F.col("_unread")
    blocks = df.filter(F.col("_v").isNotNull() & ~is_err) \
        .select(*keep, F.explode(F.from_json("_v", COMPLEXITY_BLOCKS)).alias("b")) \
        .select(*keep, "b.name", "b.lineno", "b.complexity", F.lit(None).cast("string").alias("error"))
    errors = df.filter(is_err).select(
        *keep, F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("lineno"),
        F.lit(None).cast("int").alias("complexity"), F.coalesce(F.get_json_object(F.col("_v"), "$.error"), F.lit("unreadable report")).alias("error"))
    return blocks.unionByName(errors)


def complexity_report_findings(blocks: DataFrame) -> DataFrame:
    """D5 over ingested reports: complexity > 10 → high performance finding."""
    hits = blocks.filter(F.col("error").isNull() & (F.coalesce("complexity", F.lit(0)) > COMPLEXITY_LIMIT))
    df = hits.select(
        F.lit(None).cast("string").alias("repo_id") if "repo_id" not in hits.columns else F.col("repo_id"),
        F.col("path").alias("file"), F.coalesce("lineno", F.lit(0)).alias("line"),
        F.lit("high").alias("severity"), F.lit("performance").alias("category"),
        F.lit(COMPLEXITY_TITLE).alias("title"),
        F.format_string(COMPLEXITY_MESSAGE, F.col("name"), F.col("complexity")).alias("description"),
        F.lit(False).alias("auto_fixable"), F.lit("performance").alias("stage"), F.lit(3).alias("stage_order"),
        F.coalesce("lineno", F.lit(0)).cast("long").alias("seq"))
    return complete_findings(df)
