"""Scores, grades, ordering (T1/T2), counts, heat, top-k, dedup, positions."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from revline.functions.severity import grade
from revline.operators import synthesis as S
from revline.operators.ordering import positions

from conftest import findings_df


def _f(repo, sev, stage="static", seq=0, title="t", fix=False, line=1):
    return {"repo_id": repo, "file": "a.py", "line": line, "severity": sev, "category": "style", "title": title,
            "description": "d", "auto_fixable": fix, "stage": stage, "stage_order": 0, "seq": seq}


def test_scores_grades_and_empty_repo(spark):
    f = findings_df(spark, [_f("a", "critical", seq=1), _f("a", "high", seq=2), _f("a", "convention", seq=3),
                            _f("b", "low", seq=1)])
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo_id string")
    rows = {r["repo_id"]: r for r in S.repo_scores(f, repos).collect()}
    assert rows["a"]["score"] == 70 and rows["a"]["grade_root"] == "C" and rows["a"]["grade_src"] == "C"
    assert rows["b"]["score"] == 98 and rows["b"]["grade_root"] == "A+"
    assert rows["c"]["score"] == 100 and rows["c"]["n_findings"] == 0 and rows["c"]["colour"] == "green"


def test_grade_boundaries(spark):
    df = spark.createDataFrame([(s,) for s in [90, 89, 85, 84, 80, 79, 75, 74, 70, 69, 65, 64, 60, 59, -40]], "score int")
    out = {r["score"]: (r["r"], r["s"]) for r in df.select("score", grade("score", "root").alias("r"),
                                                            grade("score", "src").alias("s")).collect()}
    assert out[90] == ("A+", "A+") and out[89] == ("A", "B") and out[85] == ("A", "B") and out[84] == ("B+", "B")
    assert out[80] == ("B+", "B") and out[79] == ("B", "C") and out[75] == ("B", "C") and out[74] == ("C", "C")
    assert out[70] == ("C", "C") and out[69] == ("C", "D") and out[65] == ("C", "D") and out[64] == ("F", "D")
    assert out[60] == ("F", "D") and out[59] == ("F", "F") and out[-40] == ("F", "F")


def test_prioritize_is_stable_and_unknown_last(spark):
    f = findings_df(spark, [_f("a", "warning", seq=1, title="w"), _f("a", "info", seq=2, title="i"),
                            _f("a", None, seq=3, title="n"), _f("a", "high", seq=4, title="h2"),
                            _f("a", "high", seq=0, title="h1"), _f("a", "critical", seq=9, title="c")])
    got = [r["title"] for r in S.prioritize(f).orderBy("priority").collect()]
    assert got == ["c", "h1", "h2", "i", "n", "w"]  # null counts as info, unknown ranks after info
    alpha = [r["severity"] for r in S.prioritize(f, "alpha").orderBy("priority").collect()]
    assert alpha[:4] == [None, "critical", "high", "high"] and alpha[-1] == "warning"


def test_severity_counts_zero_fill_and_unknown(spark):
    f = findings_df(spark, [_f("a", "high"), _f("a", "high", seq=1), _f("a", None, seq=2), _f("a", "error", seq=3)])
    rows = {(r["severity"]): r["n"] for r in S.severity_counts(f).collect()}
    assert rows == {"critical": 0, "high": 2, "medium": 0, "low": 0, "info": 1, "error": 1}
    assert sum(rows.values()) == S.total_issues(f).collect()[0]["total_issues"]


def test_category_heat_boundaries(spark):
    rows = [_f("a", "low", stage="static", seq=i) for i in range(4)] + \
           [_f("a", "low", stage="pattern", seq=i) for i in range(5)] + \
           [_f("a", "low", stage="security", seq=i) for i in range(14)] + \
           [_f("a", "low", stage="logic", seq=i) for i in range(15)]
    got = {r["category"]: (r["n"], r["heat"]) for r in S.category_heat(findings_df(spark, rows)).collect()}
    assert got == {"Static": (4, "LOW"), "Pattern": (5, "MED"), "Security": (14, "MED"),
                   "Performance": (0, "LOW"), "Logic": (15, "HIGH")}


def test_top_k_lines_and_defaults(spark):
    f = findings_df(spark, [_f("a", "low", seq=i, title=None if i == 0 else f"t{i}", line=None if i == 1 else i)
                            for i in range(7)])
    rows = S.top_k(f, 5).orderBy("pos").collect()
    assert len(rows) == 5 and rows[0]["headline"] == "1. [LOW] Untitled"
    assert rows[1]["location"] == "a.py:?"


def test_dedup_keeps_earliest(spark):
    a = _f("a", "low", seq=5)
    b = dict(a, seq=1, stage_order=0)
    f = findings_df(spark, [a, b, _f("a", "high", seq=2, title="other")])
    out = S.dedup_findings(f).collect()
    assert len(out) == 2
    assert [r["seq"] for r in out if r["title"] == "t"] == [1]


def test_quick_wins(spark):
    f = findings_df(spark, [_f("a", "low", seq=i, fix=i % 2 == 0, title=f"t{i}") for i in range(10)])
    rows = S.quick_wins(f, 3).orderBy("pos").collect()
    assert [r["title"] for r in rows] == ["t0", "t2", "t4"]


def test_positions_match_row_number_with_a_hot_group(spark):
    rnd = random.Random(7)
    data = [("hot" if rnd.random() < 0.4 else rnd.choice([None, f"g{rnd.randint(0, 30)}"]), rnd.choice([None, rnd.randint(0, 50)]), i)
            for i in range(3000)]
    df = spark.createDataFrame(data, "g string, k int, u int")
    w = Window.partitionBy("g").orderBy("k", "u")
    key = lambda r: (r["u"], r["pos"])
    want = sorted(df.withColumn("pos", F.row_number().over(w).cast("long")).collect(), key=key)
    for chunk in (None, [], ["k", F.floor(F.col("u") / 100)]):  # by the first order column, whole groups, finer
        got = positions(df, "g", ["k", "u"], "pos", chunk)
        assert sorted(got.collect(), key=key) == want


def test_union_and_progress(spark):
    a = findings_df(spark, [_f("a", "low")])
    b = findings_df(spark, [_f("a", "high", title="x")]).drop("cwe_id")
    assert S.union_findings(a, b).count() == 2
    scoped = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "repo_id string, path string")
    done = scoped.filter(F.col("path") != "y")
    got = {r["repo_id"]: (r["total_files"], r["files_analyzed"]) for r in S.progress_counts(scoped, done).collect()}
    assert got == {"a": (2, 1), "b": (1, 1)}
