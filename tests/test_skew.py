"""One repository, operation or package with most of the rows: right results from many even parts."""

import random

from pyspark.sql import functions as F

from revline.operators import metrics, ordering
from revline.operators import synthesis as S

from conftest import findings_df


def hot_findings(spark, n=12_000):
    """A third of the findings fall in one repository, on 20 lines of one stage."""
    rng = random.Random(1)
    rows = [dict(repo_id="hot" if i % 3 == 0 else f"r{i % 50}", file=f"f{i}", line=rng.randint(1, 20), severity=rng.choice(["high", "low"]), category="c",
                 title="t", description=str(i), auto_fixable=True, stage="security", stage_order=2, seq=rng.randint(1, 20)) for i in range(n)]
    return findings_df(spark, rows)


def test_positions_of_a_hot_repository(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 100)
    found = hot_findings(spark)
    got = S.prioritize(found).collect()
    rank = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
    repos = {}
    for r in got:
        repos.setdefault(r.repo_id, []).append(r)
    for rows in repos.values():
        rows.sort(key=lambda r: (rank[r.severity], r.stage_order, r.seq, r.id))
        assert [r.priority for r in rows] == list(range(1, len(rows) + 1))
    cut, keys = ordering.chunks(S.with_rank(found), "repo_id", S.PRIORITY_ORDER, [*S.PRIORITY_ORDER[:2], F.floor(F.col("seq") / S.SEQ_CHUNK)], ["seq", "id"])
    sizes = [r["count"] for r in cut.where("repo_id = 'hot'").groupBy(*keys).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 100 and len(sizes) >= 2 * 20 * 16 / 2
    task = [r["count"] for r in cut.repartition(8, *keys).groupBy(F.spark_partition_id()).count().collect()]
    assert max(task) < 2 * sorted(task)[len(task) // 2]


def test_small_repositories_are_one_chunk_and_tell_their_size(spark, monkeypatch):
    found = S.with_rank(hot_findings(spark, 600))
    chunk = [*S.PRIORITY_ORDER[:2], F.floor(F.col("seq") / S.SEQ_CHUNK)]
    cut, keys = ordering.chunks(found, "repo_id", S.PRIORITY_ORDER, chunk, ["seq", "id"])
    assert cut.groupBy(*keys).count().count() == found.select("repo_id").distinct().count()
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 50)  # the hot one is cut, the others are not
    got = ordering.positions(found, "repo_id", S.PRIORITY_ORDER, "pos", chunk, ["seq", "id"], "n").collect()
    want = {r.repo_id: r["count"] for r in found.groupBy("repo_id").count().collect()}
    assert all(r.n == want[r.repo_id] for r in got) and sorted(r.pos for r in got if r.repo_id == "hot") == list(range(1, want["hot"] + 1))


def test_null_repositories_and_ids_keep_their_places(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK_ROWS", 2)
    df = spark.createDataFrame([(None, 1, "b"), (None, 1, None), (None, 1, "a"), (None, 1, "ab"), ("x", None, "a"), ("x", 0, "a")], "g string, s int, id string")
    got = {(r.g, r.s, r.id): r.pos for r in ordering.positions(df, "g", ["s", "id"], chunk=["s"], finer=["s", "id"]).collect()}
    assert got == {(None, 1, None): 1, (None, 1, "a"): 2, (None, 1, "ab"): 3, (None, 1, "b"): 4, ("x", None, "a"): 1, ("x", 0, "a"): 2}


def test_quantiles_by_selection(spark):
    rng = random.Random(2)
    rows = [("hot", rng.random()) for _ in range(5000)] + [("ties", float(i % 3)) for i in range(100)] + [("one", 7.0), ("null", None), (None, 2.0), (None, 1.0)]
    got = {r.operation: tuple(r)[1:] for r in metrics.latency_quantiles(spark.createDataFrame(rows, "operation string, value double")).collect()}
    want = {}
    for op in {o for o, v in rows if v is not None}:
        up = sorted(v for o, v in rows if o == op and v is not None)
        want[op] = tuple(next(v for i, v in enumerate(up) if (i + 1) / len(up) >= q) for q in (0.5, 0.95, 0.99))
    assert got == want
    assert metrics.latency_quantiles(spark.createDataFrame([], "operation string, value double")).count() == 0


def test_quantile_ranges_decide_cost_only(spark, monkeypatch):
    rows = spark.range(20_000).select(F.lit("hot").alias("operation"), F.xxhash64("id").cast("double").alias("value"))
    got = []
    for n in (2, 16, 64):
        monkeypatch.setattr(metrics, "RANGES", n)
        got.append(metrics.latency_quantiles(rows).collect())
    assert got[0] == got[1] == got[2] and len(got[0]) == 1
