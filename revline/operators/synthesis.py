"""Findings → union, dedup, scores, grades, order, counts, top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revline.functions.severity import grade, grade_colour, heat, severity_rank, severity_weight
from revline.operators.ordering import positions
from revline.schema import FINDING_COLUMNS, HEAT_STAGES, SEVERITIES, STAGES

# Total order for prioritisation (T1): severity rank, union order, insertion order, id.
PRIORITY_ORDER = ["_rank", "stage_order", "seq", "id"]
# E6 variant: the severity string itself (critical, high, info, low, medium).
ALPHA_ORDER = ["severity", "stage_order", "seq", "id"]
SEQ_CHUNK = 1024  # insertion numbers that are positioned together (see ``ordering.positions``)


def union_findings(*frames: DataFrame) -> DataFrame:
    """UNION ALL of stage outputs (bag semantics, missing optional columns as null)."""
    frames = [f for f in frames if f is not None]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*[c for c in FINDING_COLUMNS if c in out.columns])


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One row per content-hash id, keeping the earliest (stage_order, seq).

    An aggregate, not a window: partial aggregation collapses repeats map-side, so an id that
    repeats a billion times costs no single task more than any other.
    """
    cols = [c for c in findings.columns if c != "id"]
    rest = F.to_json(F.struct(*[c for c in cols if c not in ("stage_order", "seq")]))  # ties: a total order
    best = F.min_by(F.struct(*cols), F.struct(F.col("stage_order"), F.col("seq"), rest))
    return findings.groupBy("id").agg(best.alias("x")).select("id", "x.*").select(*findings.columns)


def with_rank(findings: DataFrame) -> DataFrame:
    return findings.withColumn("_rank", severity_rank("severity"))


def prioritize(findings: DataFrame, mode: str = "rank", pos_col: str = "priority", size_col: str | None = None) -> DataFrame:
    """The position of each finding in its repo's prioritised list (and that list's length)."""
    order = PRIORITY_ORDER if mode == "rank" else ALPHA_ORDER
    chunk = [*order[:2], F.floor(F.col("seq") / SEQ_CHUNK)]
    return positions(with_rank(findings), "repo_id", order, pos_col, chunk, ["seq", "id"], size_col).drop("_rank")


def repo_scores(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """score = 100 − penalties; both grade scales and the grade colour.

    ``repos`` (a frame with ``repo_id``) lists repositories to report even with no findings.
    """
    agg = findings.groupBy("repo_id").agg(
        F.sum(severity_weight("severity")).alias("penalty"),
        F.count(F.lit(1)).alias("n_findings"))
    if repos is not None:
        agg = repos.select("repo_id").join(agg, "repo_id", "left")
    score = (F.lit(100) - F.coalesce(F.col("penalty"), F.lit(0))).cast("int")
    out = agg.select("repo_id", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), score.alias("score"))
    return out.select("*", grade("score", "root").alias("grade_root"), grade("score", "src").alias("grade_src")) \
        .withColumn("colour", grade_colour("grade_root"))


def severity_counts(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Per repo the five severities zero-filled, then severities seen outside the domain.

    Long form ``(repo_id, severity, n)``; a null severity counts as info. ``total`` per repo is
    the sum (E8). ``repos`` lists repositories to report even with no findings.
    """
    sev = F.coalesce(F.col("severity"), F.lit("info"))
    seen = findings.groupBy("repo_id", sev.alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    # one pass over the findings: each (repo, severity) count brings zero rows, summed away where it was seen
    zero = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(0).cast("long").alias("n")) for s in SEVERITIES])
    own = F.array(F.struct("severity", "n"))
    both = seen.select("repo_id", F.explode(F.concat(own, zero)).alias("x")).select("repo_id", "x.severity", "x.n")
    if repos is not None:
        both = both.unionByName(repos.select("repo_id", F.explode(zero).alias("x")).select("repo_id", "x.severity", "x.n"))
    return both.groupBy("repo_id", "severity").agg(F.sum("n").alias("n"))


def total_issues(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_issues"))


def category_heat(findings: DataFrame) -> DataFrame:
    """Per repo the five shown stages zero-filled, with LOW / MED / HIGH heat."""
    wide = findings.groupBy("repo_id").agg(*[F.count_if(F.col("stage") == s).alias(s) for s in HEAT_STAGES])
    long = wide.unpivot("repo_id", HEAT_STAGES, "stage", "n")
    return long.select("repo_id", F.initcap("stage").alias("category"), "n", heat("n").alias("heat"))


def top_k(findings: DataFrame, k: int = 5, mode: str = "rank") -> DataFrame:
    """First k of each repo's prioritised list, with the summary lines.

    ``row_number() <= k`` is planned as a WindowGroupLimit: each map task keeps only its top k
    per repo before the shuffle, so a huge repo sends k rows per task, not all of them.
    """
    order = PRIORITY_ORDER if mode == "rank" else ALPHA_ORDER
    w = Window.partitionBy("repo_id").orderBy(*order)
    ranked = with_rank(findings).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    title = F.coalesce("title", F.lit("Untitled"))
    return ranked.select(
        "repo_id", "pos", "id", "severity",
        F.format_string("%d. [%s] %s", F.col("pos"), F.upper(F.coalesce("severity", F.lit("info"))), title).alias("headline"),
        F.concat(F.coalesce("file", F.lit("Unknown file")), F.lit(":"),
                 F.coalesce(F.col("line").cast("string"), F.lit("?"))).alias("location"),
    )


def quick_wins(findings: DataFrame, k: int = 3) -> DataFrame:
    """Auto-fixable findings, the first k per repo in priority order."""
    w = Window.partitionBy("repo_id").orderBy(*PRIORITY_ORDER)
    return with_rank(findings.filter(F.col("auto_fixable"))) \
        .withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k) \
        .select("repo_id", "pos", "id", "severity", "title")


def stage_counts(findings: DataFrame) -> DataFrame:
    """Findings per (repo, stage), all seven stages zero-filled (state list lengths)."""
    wide = findings.groupBy("repo_id").agg(*[F.count_if(F.col("stage") == s).alias(s) for s in STAGES])
    return wide.unpivot("repo_id", STAGES, "stage", "n")


def progress_counts(scoped: DataFrame, analyzed: DataFrame) -> DataFrame:
    """``total_files`` counted before any cap, ``files_analyzed`` after it."""
    total = scoped.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"))
    done = analyzed.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files_analyzed"))
    return total.join(done, "repo_id", "left").select(
        "repo_id", "total_files", F.coalesce("files_analyzed", F.lit(0)).alias("files_analyzed"))
