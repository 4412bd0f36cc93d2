"""File versions at a commit and the files changed between two commits.

``file_versions(repo_id, path, commit_seq, version_id, content, is_deleted)`` with a linear
history. The as-of lookup is an aggregate (``max_by``), not a window: it is combined map-side, so
a path with a million versions is no harder than one with two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(versions: DataFrame, at_commit: int) -> DataFrame:
    """Each live file as of ``at_commit`` (latest version at or before it, deletions dropped)."""
    latest = versions.filter(F.col("commit_seq") <= at_commit).groupBy("repo_id", "path").agg(
        F.max_by(F.struct("commit_seq", "version_id", "content", "is_deleted"),
                 F.struct("commit_seq", "version_id")).alias("v"))
    return latest.filter(~F.col("v.is_deleted")).select(
        "repo_id", "path", "v.commit_seq", "v.version_id", "v.content")


def changed_files(versions: DataFrame, from_commit: int, to_commit: int) -> DataFrame:
    """Files whose content differs between two commits; renames show as delete + add."""
    # hashes and presence flags travel, not contents; a null content is a content like any other
    hashed = versions.withColumn("content", F.sha2(F.col("content").cast("binary"), 256))
    side = lambda at, h, there: snapshot(hashed, at).select(
        "repo_id", "path", F.col("content").alias(h), F.lit(True).alias(there))
    j = side(from_commit, "_a", "_in_a").join(side(to_commit, "_b", "_in_b"), ["repo_id", "path"], "full_outer")
    kind = F.when(F.col("_in_a").isNull(), F.lit("added")).when(F.col("_in_b").isNull(), F.lit("deleted")) \
        .when(~F.col("_a").eqNullSafe(F.col("_b")), F.lit("modified"))
    return j.select("repo_id", "path", kind.alias("change_type")).filter(F.col("change_type").isNotNull())


def missing_files(versions: DataFrame, wanted: DataFrame, at_commit: int) -> DataFrame:
    """An error row for each wanted ``(repo_id, path)`` that is no live file as of ``at_commit``."""
    live = snapshot(versions.withColumn("content", F.lit(None).cast("string")), at_commit).select("repo_id", "path")
    lost = wanted.select("repo_id", "path").distinct().join(live, ["repo_id", "path"], "left_anti")
    return lost.withColumn("error", F.concat(F.lit("Error reading file: "), "path"))
