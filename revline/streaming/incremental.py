"""The review run incrementally with Structured Streaming.

Files (or events) arrive on a file source; the stateless steps (scope, parse, detectors) run per
micro-batch and the scores are running aggregates. Results go through ``foreachBatch`` into a
table under the shared checkpoint folder. In update mode a batch appends only the changed keys
(tagged with the batch id) and readers take the latest row per key; in complete mode a batch
rewrites the whole result. Either way a replayed batch after a failure writes the same rows.
State is one row per key (repo or run) and is kept for the life of the query (no watermark:
the reference has no event time).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revline.functions.severity import severity_weight
from revline.session import scratch_path
from revline.streaming.live import LiveReview


def stream_file_table(spark: SparkSession, folder: str, schema, glob: str | None = None,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming frame over the parquet files of a folder (optionally those matching ``glob``)."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def running_scores(findings: DataFrame) -> DataFrame:
    """E2 as a running aggregate: penalty and count per repo, score derived."""
    agg = findings.groupBy("repo_id").agg(F.sum(severity_weight("severity")).alias("penalty"),
                                          F.count(F.lit(1)).alias("n_findings"))
    return agg.select("repo_id", "n_findings", (F.lit(100) - F.col("penalty")).cast("int").alias("score"))


def run_reviews(spark: SparkSession, files: DataFrame, name: str, version: str | None = None, detectors=None) -> DataFrame:
    """Review a stream of ``files(repo_id, path, content)``; (repo_id, n_findings, score) over each file's latest push.

    Held by state (``streaming.live``): a file pushed again, clean or deleted from the rules' sight, takes back its
    earlier findings; a repository whose files are all clean scores 100. Of pushes without a ``version`` the later
    batch counts, within a batch the larger digest of the content.
    """
    return LiveReview(spark, name).run(files, version, detectors).scores()


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "update",
                 keys: list[str] | None = None, trigger_once: bool = True) -> DataFrame:
    """Run ``stream`` to the end of the available input and return the result table.

    ``update`` (default): each micro-batch appends only the keys whose aggregate changed, tagged
    with the batch id; the result is the latest row per key (``max_by`` on the batch id), so a
    batch costs what changed, not the whole state. A replayed batch appends identical rows.
    ``complete``: each batch rewrites the whole result (small results only).
    """
    base = scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:8]}")
    out, ckpt = f"{base}/data", f"{base}/_checkpoint"
    if mode == "update" and not keys:
        raise ValueError("update mode needs the result keys")

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:
            batch.withColumn("_batch", F.lit(epoch_id).cast("long")).write.mode("append").parquet(out)

    writer = stream.writeStream.outputMode(mode).foreachBatch(write_batch).option("checkpointLocation", ckpt)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    q = writer.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    try:
        written = spark.read.parquet(out)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], stream.schema)  # no batch wrote anything
    if mode == "complete":
        return written
    cols = [c for c in written.columns if c not in keys and c != "_batch"]
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("_batch")).alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols])
