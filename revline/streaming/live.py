"""G4, E7 with state: running scores and severity counts over a stream of pushed files; daily counts by event time.

Every push is reviewed once, in the batch it arrives in. A stateful operator holds for each
file the version and the severity counts of its latest push, and emits only what a push changes: so many findings of
a severity more or fewer. A batch adds these changes up for each repository into a folder named after it, so a
replayed batch replaces its own rows; every ``COMPACT`` batches the changes so far are folded into a snapshot. An
answer reads the last snapshot and the changes since, never the pushes.

State is a small entry for each file (RocksDB, under the shared checkpoint folder). Files are dealt by a hash to
``BUCKETS`` keys and the entries of a bucket are held together, so a batch makes at most that many calls, however many
files it brings; a push rewrites the entries of its bucket. A file whose latest push has no
findings is forgotten ``hold_ms`` after that push, by a timeout; an older push that arrives later still than that
counts as new.

Defined results: of several pushes of a file in a batch the one with the largest (version, digest of the content)
counts, a null version is 0; a push older than the latest is ignored, one of equal version replaces it; a
repository whose files are all clean keeps its row (score 100); a null repository is one of its own.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from revline.functions.severity import severity_weight
from revline.operators import detectors as D
from revline.schema import SEVERITIES
from revline.session import scratch_path

COMPACT = 16
BUCKETS = 16_384  # keys the files are dealt to
HOLD_MS = 24 * 3600 * 1000
CHANGE = "repo_id string, severity string, delta long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_push(hold_ms: int):
    """For ``applyInPandasWithState``: holds the latest push of each file of a bucket, emits the changes of their severity counts."""
    def f(key, rows, state):
        best = {}
        for pdf in () if state.hasTimedOut else rows:
            for file, repo, version, push, found in zip(pdf["file"], pdf["repo_id"], pdf["version"], pdf["push"], pdf["severities"]):
                if file not in best or (version, push) > best[file][:2]:
                    best[file] = (int(version), push, repo, found)
        # file: version, severity counts, and for a clean file the time from which it is forgotten
        held = json.loads(state.get[0]) if state.exists else {}
        now_ms = int(time.time() * 1000)
        held = {file: entry for file, entry in held.items() if file in best or entry[2] is None or entry[2] > now_ms}
        change = Counter()
        for file, (version, _, repo, found) in best.items():
            known = file in held
            last, before, _ = held.get(file, (version, {}, None))
            if last > version:
                if not before:
                    held[file][2] = now_ms + hold_ms
                continue
            now = dict(Counter(found))
            held[file] = [version, now, None if now else now_ms + hold_ms]
            for s in {*now, *before}:
                if now.get(s, 0) != before.get(s, 0):
                    change[repo, s] += now.get(s, 0) - before.get(s, 0)
            if not known:
                change[repo, None] += 0  # the repository exists
        if held:
            state.update((json.dumps(held),))
            until = [entry[2] for entry in held.values() if entry[2] is not None]
            if until:
                state.setTimeoutDuration(max(1, min(until) - now_ms))
        elif state.exists:
            state.remove()
        if change:
            yield pd.DataFrame([(*k, n) for k, n in change.items()], columns=["repo_id", "severity", "delta"])
    return f


def changes(files: DataFrame, version: str | None = None, detectors=None, hold_ms: int = HOLD_MS) -> DataFrame:
    """The stream of changes (repo_id, severity, delta) of a stream of ``files(repo_id, path, content[, version])``."""
    names = list(detectors or D.ALL_DETECTORS)
    push = F.struct("repo_id", "path", (F.col(version).cast("long") if version else F.lit(0).cast("long")).alias("version"),
                    F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("push"))
    # the parser carries the repository: here all that tells a push
    keyed = files.select(F.to_json(push).alias("repo_id"), "path", "content")
    reviewed = D.file_facts(keyed) if D.PARSE_DETECTORS & set(names) else D.prepare_files(keyed)
    told = F.from_json("repo_id", "repo_id string, path string, version long, push string")
    rows = reviewed.select(told.alias("p"), F.transform(D.findings_array(names), lambda f: f["severity"]).alias("severities"))
    rows = rows.select(F.to_json(F.struct("p.repo_id", "p.path")).alias("file"), "p.repo_id", F.coalesce("p.version", F.lit(0)).alias("version"),
                       F.col("p.push").alias("push"), "severities")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(
        latest_push(hold_ms), CHANGE, "files string", "update", GroupStateTimeout.ProcessingTimeTimeout)


class LiveReview:
    """Running answers over the pushes streamed so far; one folder under the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str, base: str | None = None, compact: int = COMPACT):
        self.spark, self.compact = spark, compact
        self.base = base or scratch_path(spark, f"live-{name}-{uuid.uuid4().hex[:8]}")

    def run(self, files: DataFrame, version: str | None = None, detectors=None, hold_ms: int = HOLD_MS) -> "LiveReview":
        """Take in all that is available; a later call goes on where this one ended."""
        # timeouts are looked at when pushes come: no batch runs for them alone
        settings = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                conf.set(k, v)
            q = changes(files, version, detectors, hold_ms).writeStream.outputMode("update").foreachBatch(self._write) \
                .option("checkpointLocation", f"{self.base}/_checkpoint").trigger(availableNow=True).start()
            q.awaitTermination()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self

    def _write(self, batch: DataFrame, epoch_id: int) -> None:
        batch.groupBy("repo_id", "severity").agg(F.sum("delta").alias("delta")) \
            .write.mode("overwrite").parquet(f"{self.base}/changes/batch={epoch_id}")
        if (epoch_id + 1) % self.compact == 0:
            self._sum(epoch_id).write.mode("overwrite").parquet(f"{self.base}/snapshots/upto={epoch_id}")

    def _read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.base}/{part}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def _sum(self, upto: int | None = None) -> DataFrame:
        """(repo_id, severity, delta): the snapshot before ``upto`` and the changes after it, added up."""
        new, old = self._read("changes"), self._read("snapshots")
        if new is None:
            return self.spark.createDataFrame([], CHANGE)
        if upto is not None:
            new = new.where(F.col("batch") <= upto)
        if old is not None:
            old = old.where(F.col("upto") < upto) if upto is not None else old
            last = old.agg(F.max("upto")).first()[0]
            if last is not None:
                new = new.where(F.col("batch") > last).drop("batch").unionByName(old.where(F.col("upto") == last).drop("upto"))
        return new.groupBy("repo_id", "severity").agg(F.sum("delta").alias("delta"))

    def severity_counts(self) -> DataFrame:
        """(repo_id, severity, n), the five severities filled with zeros, others as seen."""
        got = self._sum()
        zero = got.select("repo_id").distinct().select("repo_id", F.explode(F.array(*[F.lit(s) for s in SEVERITIES])).alias("severity"), F.lit(0).cast("long").alias("delta"))
        both = got.where("severity is not null").unionByName(zero).groupBy("repo_id", "severity").agg(F.sum("delta").alias("n"))
        return both.where((F.col("n") > 0) | F.col("severity").isin(list(SEVERITIES)))

    def scores(self) -> DataFrame:
        """(repo_id, n_findings, score)."""
        return self._sum().groupBy("repo_id").agg(
            F.sum(F.when(F.col("severity").isNotNull(), F.col("delta")).otherwise(0)).alias("n_findings"),
            (F.lit(100) - F.sum(F.when(F.col("severity").isNotNull(), severity_weight("severity") * F.col("delta")).otherwise(0))).cast("int").alias("score"))


def daily_counts(findings: DataFrame, delay: str = "1 day", time_col: str = "ts") -> DataFrame:
    """Findings per repository, severity and day of a stream, by event time, in append mode.

    A finding that comes again (same ``id``) within the delay counts once. A day is given out when the watermark (the
    latest time seen less ``delay``) has passed its end; rows older than the watermark are dropped as late.
    """
    once = findings.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["id"])
    days = once.groupBy(F.window(time_col, "1 day"), "repo_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("window.start") / 86400).cast("int"))
    return days.select(day.alias("day"), "repo_id", "severity", "n")


def run_append(spark: SparkSession, stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Run an append-mode stream over all available input and return what it has given out."""
    base = base or scratch_path(spark, f"append-{name}-{uuid.uuid4().hex[:8]}")

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/batch={epoch_id}")

    q = stream.writeStream.outputMode("append").foreachBatch(write_batch).option("checkpointLocation", f"{base}/_checkpoint") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        return spark.read.parquet(f"{base}/data").drop("batch")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], stream.schema)
