"""Report and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_FORMATS = ["markdown", "json", "html", "all"]


def write_report(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write ``(repo_id, pos, text)`` rows as one text folder per repository.

    The global sort splits big repositories over several tasks; files of one folder, read in
    name order, hold the report in order. Each row ends with the text's own final newline.
    """
    ordered = lines.repartitionByRange(partitions, "repo_id", "pos") if partitions else lines
    ordered = ordered.orderBy("repo_id", "pos") if not partitions else ordered.sortWithinPartitions("repo_id", "pos")
    ordered.select("repo_id", F.regexp_replace("text", "\n\\z", "").alias("value")) \
        .write.mode("overwrite").partitionBy("repo_id").text(path)


def write_reports(markdown: DataFrame | None, json_: DataFrame | None, out_dir: str, fmt: str = "markdown") -> list[str]:
    """``markdown`` / ``json`` / ``all``; ``html`` is accepted and writes nothing, as in the reference."""
    if fmt not in REPORT_FORMATS:
        raise ValueError(f"unknown report format {fmt!r}")
    written = []
    if fmt in ("markdown", "all") and markdown is not None:
        write_report(markdown, f"{out_dir}/code_review_report.md")
        written.append("markdown")
    if fmt in ("json", "all") and json_ is not None:
        write_report(json_, f"{out_dir}/code_review_report.json")
        written.append("json")
    return written


def write_findings(findings: DataFrame, path: str, buckets: int = 64) -> None:
    """The findings table, partitioned by a bucket of repo_id so a repo filter prunes folders."""
    findings.withColumn("repo_bucket", F.pmod(F.xxhash64("repo_id"), F.lit(buckets))) \
        .write.mode("overwrite").partitionBy("repo_bucket").parquet(path)


def write_issue_payloads(payloads: DataFrame, path: str) -> None:
    """Issue payloads as JSON lines (posting them to a service is not built)."""
    payloads.write.mode("overwrite").json(path)
