"""Fold a review's event stream into its latest state.

Works on a batch or a streaming frame alike. In streaming, state is one row per run (update or
complete mode); without a watermark it is kept for the life of the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revline.functions.text import py_title_from_snake


def fold_runs(events: DataFrame) -> DataFrame:
    """Last write wins for ``current_step`` (by ts, then event id); counters accumulate."""
    return events.groupBy("run_id").agg(
        F.max_by("current_step", F.struct("ts", "event_id")).alias("current_step"),
        F.sum("files_delta").alias("files_analyzed"),
        F.count(F.lit(1)).alias("n_events"))


def fold_keys(updates: DataFrame) -> DataFrame:
    """G1 for any key: ``(run_id, key, value, ts, event_id)`` to the last value written to each key of each run.

    A null written last is the value. A run's keys are rows of their own, so a run with many keys is spread.
    """
    last = F.max_by(F.struct("value", "ts"), F.struct("ts", "event_id"))
    return updates.groupBy("run_id", "key").agg(last.alias("_v"), F.count(F.lit(1)).alias("n_updates")) \
        .select("run_id", "key", F.col("_v.value").alias("value"), "n_updates")


def step_labels(folded: DataFrame) -> DataFrame:
    """``current_step`` shown with ``_`` as spaces, title case."""
    return folded.withColumn("step_label", py_title_from_snake("current_step"))


def run_check(policy_findings: DataFrame, order: str = "doc_id") -> DataFrame:
    """How many policy findings, and the first one (by ``order``)."""
    return policy_findings.agg(F.count(F.lit(1)).alias("n_policy_findings"),
                               F.min_by("file", F.col(order)).alias("first_file"),
                               F.min_by("description", F.col(order)).alias("first_description"))
