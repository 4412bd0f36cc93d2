"""Running answers over pushes equal the batch review of the final files; daily counts drop repeats and late rows."""

import json
import os

import pandas as pd
from pyspark.sql import functions as F

from revline.operators import detectors as D
from revline.operators import synthesis as S
from revline.streaming import incremental as GI
from revline.streaming import live
from conftest import SF_SMALL

SCHEMA = "repo_id string, path string, content string, version long"
BAD, GOOD, BROKEN = "import os\nos.system('x')\n", '"""d"""\nx = 1\n', "def f(:\nimport os\nos.system('y')\n"
PUSHES = [[("r", "a.py", BAD, 1), ("r", "b.py", BAD, 1), (None, "n.py", BAD, 1), ("s", "c.py", BAD, 1), ("s", "c.py", GOOD, 2)],
          [("r", "a.py", GOOD, 2), ("r", "b.py", BROKEN, 2), ("t", "e.py", "", 1)],
          [("r", "a.py", BAD, 1), ("r", "b.py", "", 3), ("s", "d.py", BAD, None), (None, "n.py", BAD, 1)]]
FINAL = [("r", "a.py", GOOD), ("r", "b.py", ""), (None, "n.py", BAD), ("s", "c.py", GOOD), ("s", "d.py", BAD), ("t", "e.py", "")]


def add_file(spark, folder, rows, schema, nth):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df.write.mode("append").parquet(folder)
    new = [os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")]
    newest = max(new, key=os.path.getmtime)
    os.utime(newest, (1_700_000_000 + nth, 1_700_000_000 + nth))


def test_pushes_equal_batch(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "in")
    review = live.LiveReview(spark, "test", base=os.path.join(tmpdir_path, "live"), compact=2)
    stream = lambda: GI.stream_file_table(spark, folder, SCHEMA, max_files_per_trigger=1)
    for n, rows in enumerate(PUSHES[:2]):
        add_file(spark, folder, rows, SCHEMA, n)
    review.run(stream(), "version")
    add_file(spark, folder, PUSHES[2], SCHEMA, 2)
    review.run(stream(), "version")  # goes on from its state
    final = spark.createDataFrame(FINAL, "repo_id string, path string, content string")
    found, repos = D.review_findings(final), final.select("repo_id").distinct()
    scores = {r.repo_id: (r.n_findings, r.score) for r in GI.running_scores(found).collect()}
    assert {r.repo_id: (r.n_findings, r.score) for r in review.scores().collect()} == {"r": (0, 100), "t": (0, 100)} | scores
    want = sorted(map(str, S.severity_counts(found, repos).select("repo_id", "severity", "n").where("repo_id is not null").collect()))
    got = review.severity_counts()
    assert sorted(map(str, got.where("repo_id is not null").collect())) == want and got.where("repo_id is null and n > 0").count() == 2
    # answers read the snapshot and what came after it, not the pushes
    plan = review.scores()._jdf.queryExecution().executedPlan().toString()
    assert "(batch#" in plan.split("PartitionFilters", 1)[1] and " > 1)" in plan and " = 1)" in plan


def test_clean_files_are_forgotten(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "in")
    review = live.LiveReview(spark, "hold", base=os.path.join(tmpdir_path, "live"))
    for n, rows in enumerate([[("r", "a.py", BAD, 1)], [("r", "a.py", "", 2)], [("r", "x.py", "", 1)], [("r", "a.py", BAD, 1)]]):
        add_file(spark, folder, rows, SCHEMA, n)
        review.run(GI.stream_file_table(spark, folder, SCHEMA, max_files_per_trigger=1), "version", hold_ms=1)
    # the clean push was forgotten, so the old version counts as new
    assert review.scores().first().n_findings == 2


def test_nothing_pushed(spark, tmpdir_path):
    os.makedirs(os.path.join(tmpdir_path, "none"))
    review = live.LiveReview(spark, "none").run(GI.stream_file_table(spark, os.path.join(tmpdir_path, "none"), SCHEMA), "version")
    assert review.scores().count() == 0 == review.severity_counts().count()


def test_daily_counts_drop_repeats_and_late_rows(spark, tmpdir_path):
    schema = "id string, repo_id string, severity string, day double"
    batches = [[("1", "r", "high", 0.1), ("1", "r", "high", 0.2), ("2", "r", "high", 0.9), ("3", "r", "low", 1.5)],
               [("4", "r", "high", 3.0), ("2", "r", "high", 1.0)], [("5", "r", "high", 0.5), ("6", "r", "low", 2.5)], [("7", "r", "low", 6.0)]]
    folder = os.path.join(tmpdir_path, "in")
    for n, rows in enumerate(batches):
        add_file(spark, folder, rows, schema, n)
    stream = GI.stream_file_table(spark, folder, schema, max_files_per_trigger=1) \
        .withColumn("ts", F.timestamp_seconds((F.col("day") * 86400).cast("long"))).drop("day")
    got = live.run_append(spark, live.daily_counts(stream, "1 day"), "days").collect()
    rows = {(str(r.day), r.severity): r.n for r in got}
    # 1 counts once; 5 comes when the watermark stands at day 2; day 3 (4) is given out behind day 5, day 6 not yet
    assert rows == {("1970-01-01", "high"): 2, ("1970-01-02", "low"): 1, ("1970-01-03", "low"): 1, ("1970-01-04", "high"): 1}


class _State:
    """What ``latest_push`` asks of a group's state."""

    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.timeout = value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_files_of_a_bucket_share_a_call():
    pdf = lambda *rows: pd.DataFrame(rows, columns=["file", "repo_id", "version", "push", "severities"])
    state, call = _State(), live.latest_push(60_000)
    out = lambda *rows: sorted((tuple(r) for d in call((1,), iter([pdf(*rows)]), state) for r in d.values.tolist()), key=str)
    assert out(("a", "r", 1, "x", ["high", "low"]), ("b", "r", 1, "x", ["low"]), ("c", "s", 1, "x", [])) == \
        [("r", "high", 1), ("r", "low", 2), ("r", None, 0), ("s", None, 0)]
    assert 0 < state.timeout <= 60_000  # c is clean
    # b is older than what is held, a has one finding less
    assert out(("a", "r", 2, "x", ["low"]), ("b", "r", 0, "x", [])) == [("r", "high", -1)]
    gone = _State(state.value, timed_out=True)
    assert not list(live.latest_push(0)((1,), iter(()), gone)) and gone.exists  # a and b have findings
    late = _State((json.dumps({"c": [1, {}, 1], "a": [2, {"low": 1}, None]}),), timed_out=True)
    assert not list(call((1,), iter(()), late)) and list(json.loads(late.value[0])) == ["a"]


def test_stream_queries_spread_their_rows(spark, tmpdir_path, monkeypatch):
    """A table in one file, and pushes written for a stream, are reviewed by more than one task."""
    from revline.plans import catalog
    tasks = []
    file_facts = D.file_facts
    monkeypatch.setattr(D, "file_facts", lambda files: tasks.append(files) or file_facts(files))
    folders = []
    reader = GI.stream_file_table
    monkeypatch.setattr(GI, "stream_file_table", lambda spark, folder, *a, **k: folders.append((folder, k)) or reader(spark, folder, *a, **k))
    catalog.QUERIES["stream_scores"](spark, SF_SMALL)
    assert "RepartitionByExpression" in tasks[0]._jdf.queryExecution().logical().toString()
    folders.clear()
    catalog.QUERIES["stream_severity_counts"](spark, SF_SMALL)
    assert len(folders) == 3 and all(not k for _, k in folders)  # a run of the stream for each push
    assert sum(f.endswith(".parquet") for f in os.listdir(folders[0][0].removeprefix("file:"))) > 3
