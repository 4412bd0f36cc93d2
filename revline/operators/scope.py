"""Which files and findings a review covers. All native; apply before the parse step
(Catalyst does not push filters below ``mapInPandas``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revline.functions.glob import globs_regex, globs_to_regex
from revline.functions.severity import meets_threshold

# --- fixed values: folder markers (substring of the directory path) and default globs ---------
BOOTSTRAP_EXCLUDES = ["node_modules", ".git", ".gemini"]
FULL_PHASE_EXCLUDES = ["node_modules", ".git", ".gemini", ".cache", "logs"]
DEFAULT_EXCLUDE_GLOBS = ["**/node_modules/**", "**/vendor/**", "**/*.test.js", "**/*.spec.py"]
SCOPES = ["full", "branch", "files", "diff", "security_only", "performance_only"]
# ----------------------------------------------------------------------------------------------


def directory(path="path") -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.when(p.isNotNull(), F.lit("")))


def python_files(df: DataFrame, path: str = "path", ext: str = ".py") -> DataFrame:
    """B1."""
    return df.filter(F.col(path).endswith(ext))


def exclude_dirs(df: DataFrame, markers=None, path: str = "path") -> DataFrame:
    """B2: drop files whose directory contains any marker as a substring (so .git drops .github)."""
    markers = list(BOOTSTRAP_EXCLUDES if markers is None else markers)
    if not markers:
        return df
    d = directory(path)
    return df.filter(~F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: d.contains(m)))


def exclude_globs(df: DataFrame, globs=None, path: str = "path") -> DataFrame:
    """Drop paths matching any glob (``**/`` matches zero or more folders)."""
    rx = globs_to_regex(DEFAULT_EXCLUDE_GLOBS if globs is None else globs)
    return df if rx is None else df.filter(~F.col(path).rlike(rx))


def exclude_configured(files: DataFrame, config: DataFrame, path: str = "path") -> DataFrame:
    """B3 with each repository's own ``exclude_patterns``; repositories without any keep all files."""
    patterns = config.select("repo_id", globs_regex(F.col("exclude_patterns")).alias("_rx")).where("_rx IS NOT NULL")
    hit = F.rlike(F.col(path), F.col("_rx"))
    return files.join(patterns, "repo_id", "left").filter(~F.coalesce(hit, F.lit(False))).select(*files.columns)


def cap_files(df: DataFrame, max_files: int | None, repo: str = "repo_id", path: str = "path") -> DataFrame:
    """First ``max_files`` per repo by path (off when None). A WindowGroupLimit plan."""
    if max_files is None:
        return df
    w = Window.partitionBy(repo).orderBy(path)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_files).drop("_n")


def select_scope(files: DataFrame, scope: str = "full", target_files=None,
                 changed: DataFrame | None = None, branch: str | None = None) -> DataFrame:
    """Full → all; files → the given paths; diff → files in ``changed`` (repo_id, path);
    branch → rows of that branch (needs a ``branch`` column). ``*_only`` scopes keep all files
    and narrow the findings instead (see ``stage_filter``)."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    if scope == "files":
        return files.filter(F.col("path").isin(list(target_files or [])))
    if scope == "diff":
        if changed is None:
            raise ValueError("diff scope needs the changed files")
        return files.join(changed.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    if scope == "branch":
        if branch is None:
            raise ValueError("branch scope needs a branch")
        return files.filter(F.col("branch") == branch)
    return files


def stage_filter(findings: DataFrame, scope: str) -> DataFrame:
    if scope == "security_only":
        return findings.filter(F.col("category") == "security")
    if scope == "performance_only":
        return findings.filter(F.col("category") == "performance")
    return findings


def apply_config(findings: DataFrame, config: DataFrame) -> DataFrame:
    """Per repo keep findings at or above the threshold, of an enabled check's stage,
    not in a skipped category. ``config`` is one row per repo (see ``sources.config``)."""
    check_stage = {"static_analysis": "static", "pattern_analysis": "pattern", "security_audit": "security",
                   "performance_analysis": "performance", "testing_assessment": "testing",
                   "logic_verification": "logic", "policy_verification": "policy"}
    stage_map = F.create_map(*[F.lit(x) for kv in check_stage.items() for x in kv])
    cfg = config.select(
        "repo_id", "severity_threshold",
        F.transform("enabled_checks", lambda c: F.element_at(stage_map, c)).alias("_stages"),
        F.coalesce("skip_categories", F.array().cast("array<string>")).alias("_skip"))
    # A repo without a configuration keeps everything; the policy stage has no check to switch it off.
    joined = findings.join(cfg, "repo_id", "left")
    keep = (F.coalesce(meets_threshold("severity", "severity_threshold"), F.col("severity_threshold").isNull())
            & F.coalesce(F.array_contains("_stages", F.col("stage")) | (F.col("stage") == "policy"), F.lit(True))
            & ~F.coalesce(F.array_contains("_skip", F.col("category")), F.lit(False)))
    return joined.filter(keep).drop("severity_threshold", "_stages", "_skip")
