"""Test results, coverage and latency summaries over tables of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def test_summary(results: DataFrame, repo: str = "repo_id", outcome: str = "outcome") -> DataFrame:
    """Total, failed and status per repo from ``(repo, test, outcome)``."""
    return results.groupBy(repo).agg(F.count(F.lit(1)).alias("total"),
                                     F.count_if(F.col(outcome) == "failed").alias("failed")) \
        .withColumn("status", F.when(F.col("failed") == 0, F.lit("passed")).otherwise(F.lit("failed")))


def coverage(line_hits: DataFrame, file: str = "file", hits: str = "hits", line: str | None = None) -> DataFrame:
    """Lines, covered lines and coverage in basis points (floor) per ``file`` (any grouping column).

    With ``line``, rows that repeat a line count once, by their largest number of hits.
    """
    if line:
        line_hits = line_hits.groupBy(file, line).agg(F.max(hits).alias(hits))
    return line_hits.groupBy(file).agg(F.count(F.lit(1)).alias("lines"),
                                       F.count_if(F.col(hits) > 0).alias("covered")) \
        .withColumn("coverage_bp", F.expr("(covered * 10000) div lines"))


def coverage_by_repo(line_hits: DataFrame, repo: str = "repo_id", file: str = "file", line: str = "line",
                     hits: str = "hits") -> DataFrame:
    """D20 per repository: files, distinct lines, covered lines and coverage in basis points (floor)."""
    lines = line_hits.groupBy(repo, file, line).agg(F.max(hits).alias("_hits"))
    files = lines.groupBy(repo, file).agg(F.count(F.lit(1)).alias("_lines"), F.count_if(F.col("_hits") > 0).alias("_covered"))
    return files.groupBy(repo).agg(F.count(F.lit(1)).alias("files"), F.sum("_lines").alias("lines"), F.sum("_covered").alias("covered")) \
        .withColumn("coverage_bp", F.expr("(covered * 10000) div lines"))


def latency_profile(runs: DataFrame, op: str = "operation", value: str = "value") -> DataFrame:
    """Count, exact total and mean in hundredths, min and max per operation."""
    cents = F.round(F.col(value) * 100).cast("long")
    return runs.groupBy(op).agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("total_cents"),
                                F.min(value).alias("min_value"), F.max(value).alias("max_value")) \
        .withColumn("mean_cents", F.expr("total_cents div n"))


RANGES = 64  # ranges an operation's values are cut to


def latency_quantiles(runs: DataFrame, op: str = "operation", value: str = "value",
                      quantiles=(0.5, 0.95, 0.99)) -> DataFrame:
    """Exact quantiles per operation: the smallest value that at least that share of runs does not exceed.

    A mergeable sketch of each operation gives bounds that cut its values to about equal ranges; runs are counted
    by range; only the range that holds a quantile is looked into, value by value. So no task sees more than a
    range of an operation, however many runs or distinct values it has; the bounds decide cost, not results.
    """
    known = runs.where(F.col(value).isNotNull()).select(F.col(op).alias("_op"), F.col(value).cast("double").alias("_v"))
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    sketch = known.groupBy("_op").agg(F.kll_sketch_agg_double("_v").alias("_k"))
    bounds = sketch.select(F.col("_op").alias("_o"), F.array_distinct(F.kll_sketch_get_quantile_double("_k", shares)).alias("_bounds"))
    # the range of a value: the bounds below it (bounds are sorted)
    ranged = known.join(bounds, F.col("_op").eqNullSafe(F.col("_o"))) \
        .select("_op", "_v", F.size(F.filter("_bounds", lambda b: b < F.col("_v"))).alias("_r"))
    values = ranged.groupBy("_op", "_r", "_v").agg(F.count(F.lit(1)).alias("_n"))
    sizes = values.groupBy("_op", "_r").agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy("_op").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    totals = sizes.select(F.col("_op").alias("_o"), F.col("_r").alias("_s"), (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
                          F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(Window.partitionBy("_op")).alias("_total"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(quantiles)]))
    holding = totals.withColumn("_q", asked).where((F.col("_upto") / F.col("_total") >= F.col("_q.q"))
                                                   & ((F.col("_before") / F.col("_total") < F.col("_q.q")) | (F.col("_before") == 0)))
    inside = values.join(holding, F.col("_op").eqNullSafe(F.col("_o")) & (F.col("_r") == F.col("_s")))
    within = Window.partitionBy("_op", "_r", "_q").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    share = (F.col("_before") + F.sum("_n").over(within)) / F.col("_total")
    found = inside.withColumn("_share", share).where(F.col("_share") >= F.col("_q.q"))
    return found.groupBy(F.col("_op").alias(op)).agg(*[F.min(F.when(F.col("_q.i") == i, F.col("_v"))).alias(f"p{int(round(x * 100))}")
                                                       for i, x in enumerate(quantiles)])
