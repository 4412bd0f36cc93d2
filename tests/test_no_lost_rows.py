"""Inputs on which operators used to lose rows without a word."""

import pytest
from pyspark.sql import functions as F

from conftest import files_df, findings_df
from revline.operators import policy as P
from revline.operators import scope as B
from revline.operators import synthesis as S
from revline.operators import versions as V
from revline.plans.review import review
from revline.sources import reports as REP


def test_hot_null_repo_keeps_all_positions(spark):
    rows = [dict(repo_id=None if i % 2 else f"r{i % 3}", severity=None if i % 5 == 0 else "low", seq=i, title=f"t{i}", stage_order=1)
            for i in range(400)]
    out = S.prioritize(findings_df(spark, rows))
    assert out.count() == 400
    assert sorted(r["priority"] for r in out.where("repo_id IS NULL").collect()) == list(range(1, 201))


def test_no_job_runs_while_positions_are_planned(spark):
    df = findings_df(spark, [dict(repo_id="a", severity="low", seq=1, title="t", stage_order=1)])
    spark.sparkContext.setJobGroup("plan", "plan")
    S.prioritize(df)
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_single_policy_is_found(spark):
    docs = spark.createDataFrame([(1, "queries must use parameterised statements"), (2, "nothing shared here")], "doc_id long, text string")
    for n in (1, 3, 9):
        policies = spark.createDataFrame([(i, "always use parameterised statements") for i in range(n)], "item_id long, text string")
        top = P.topk_policies(docs, policies, k=1).collect()
        assert [(r["doc_id"], r["item_id"], r["score"]) for r in top] == [(1, 0, 3)]


def test_config_keeps_repos_without_a_row_and_policy_findings(spark):
    f = findings_df(spark, [dict(repo_id=r, severity="high", title=s, stage=s, category=s, stage_order=1, seq=1)
                            for r in ("configured", "other") for s in ("static", "policy", "performance")])
    cfg = spark.createDataFrame([("configured", "low", ["static_analysis"], None)],
                                "repo_id string, severity_threshold string, enabled_checks array<string>, skip_categories array<string>")
    got = {(r["repo_id"], r["stage"]) for r in B.apply_config(f, cfg).collect()}
    assert got == {("configured", "static"), ("configured", "policy"), ("other", "static"), ("other", "policy"), ("other", "performance")}


def test_full_review_excludes_nothing_unless_asked(spark):
    src = "import os\nos.system('x')\n"
    files = files_df(spark, [("r", "vendor/x.py", src), ("r", "t/a.spec.py", src)])
    assert {r["file"] for r in review(files, persist=False).findings.collect()} == {"vendor/x.py", "t/a.spec.py"}
    some = review(files, exclude_globs=["**/vendor/**"], persist=False)
    assert {r["file"] for r in some.findings.collect()} == {"t/a.spec.py"}


def test_two_columns_of_a_line_are_two_findings(spark):
    report = '[{"path":"a.py","line":3,"column":%d,"type":"warning","message":"m","message-id":"W1","symbol":"s"}]'
    issues = REP.ingest_lint(spark.createDataFrame([("a.py", report % 1), ("a.py", report % 9)], "path string, report string"))
    assert S.dedup_findings(REP.lint_findings(issues)).count() == 2


@pytest.mark.parametrize("ingest", [REP.ingest_lint, REP.ingest_complexity])
def test_unreadable_reports_are_error_rows(spark, ingest):
    rows = [("a.py", None), ("b.py", "[{not json"), ("c.py", "plain text"), ("d.py", "")]
    out = ingest(spark.createDataFrame(rows, "path string, report string")).collect()
    assert {(r["path"], r["error"]) for r in out} == {(p, "unreadable report") for p, _ in rows}


def test_files_at_the_root_have_no_directory(spark):
    df = files_df(spark, [("r", "mylogs.py", ""), ("r", "x.gitignore_tool.py", ""), ("r", "logs/a.py", "")])
    assert {r["path"] for r in B.exclude_dirs(df, B.FULL_PHASE_EXCLUDES).collect()} == {"mylogs.py", "x.gitignore_tool.py"}


def test_scope_reaches_tool_reports_and_branch(spark):
    files = files_df(spark, [("r", "a.py", "x = 1\n"), ("r", "b.py", "x = 1\n")])
    report = '[{"path":"p","line":1,"column":1,"type":"warning","message":"m","message-id":"W1","symbol":"s"}]'
    lint = spark.createDataFrame([("r", "a.py", report), ("r", "b.py", report)], "repo_id string, path string, report string")
    got = review(files, scope="files", target_files=["a.py"], lint_reports=lint, persist=False)
    assert {r["file"] for r in got.findings.where("category = 'style'").collect()} == {"a.py"}
    branches = files.withColumn("branch", F.when(F.col("path") == "a.py", "main").otherwise("dev"))
    with pytest.raises(ValueError):
        review(branches, scope="branch", persist=False)
    assert B.select_scope(branches, "branch", branch="dev").count() == 1


def test_versions_with_null_contents(spark):
    rows = [("r", "new.py", 2, 1, None, False), ("r", "emptied.py", 1, 1, "x", False), ("r", "emptied.py", 2, 2, None, False),
            ("r", "same.py", 1, 1, None, False), ("r", "gone.py", 1, 1, None, False), ("r", "gone.py", 2, 2, None, True)]
    v = spark.createDataFrame(rows, "repo_id string, path string, commit_seq int, version_id int, content string, is_deleted boolean")
    got = {(r["path"], r["change_type"]) for r in V.changed_files(v, 1, 2).collect()}
    assert got == {("new.py", "added"), ("emptied.py", "modified"), ("gone.py", "deleted")}


def test_severity_counts_in_one_pass_with_listed_repos(spark):
    f = findings_df(spark, [dict(repo_id="a", severity=s, seq=i, title="t") for i, s in enumerate(["low", None, "odd", "low"])])
    counted = S.severity_counts(f, spark.createDataFrame([("a",), ("b",)], "repo_id string"))
    got = {(r["repo_id"], r["severity"]): r["n"] for r in counted.collect()}
    assert got[("a", "low")] == 2 and got[("a", "info")] == 1 and got[("a", "odd")] == 1
    assert {s for r, s in got if r == "b"} == {"critical", "high", "medium", "low", "info"}
    assert sum(got.values()) == 4


def test_decode_ignore_keeps_valid_replacement_characters(spark):
    from revline.functions.text import decode_utf8_ignore
    df = spark.createDataFrame([(1, "a�b".encode()), (2, b"a\xffb")], "k int, b binary")
    assert [r[0] for r in df.orderBy("k").select(decode_utf8_ignore("b")).collect()] == ["a�b", "ab"]
