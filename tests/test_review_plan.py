"""The whole review plan: invariants across its outputs."""

from pyspark.sql import functions as F

from revline.functions.severity import severity_weight
from revline.operators.rules import DEFAULT_POLICY_RULES, DEFAULT_RULES
from revline.plans.review import review
from revline.sources.config import effective_config

from conftest import files_df


def _files(spark):
    long_fn = "def f(a):\n" + "\n".join(f"    x = {i}" for i in range(1, 120))
    return files_df(spark, [
        ("r1", "src/a.py", long_fn), ("r1", "src/b.py", "import os\nos.system('x')"),
        ("r1", "node_modules/c.py", "def f(:"), ("r1", "src/bad.py", "def f(:"),
        ("r2", "pkg/d.py", '"""doc"""\ndef g(a, b, c, d, e, f):\n    pass\n'), ("r3", "x.js", "var a;")])


def test_review_invariants(spark):
    files = _files(spark)
    lint = spark.createDataFrame([("r1", "src/a.py", '[{"path": "src/a.py", "line": 1, "type": "warning", '
                                                     '"message": "m", "message-id": "W1", "symbol": "s"}]'),
                                  ("r2", "pkg/d.py", '{"error": "Pylint timeout"}')],
                                 "repo_id string, path string, report string")
    repos = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "repo_id string")
    r = review(files, repos=repos, lint_reports=lint, exclude_globs=["**/node_modules/**"])
    f = r.findings
    assert f.filter(F.col("file").startswith("node_modules")).count() == 0
    pen = {x["repo_id"]: x["p"] for x in f.groupBy("repo_id").agg(F.sum(severity_weight()).alias("p")).collect()}
    for s in r.scores.collect():
        assert s["score"] + pen.get(s["repo_id"], 0) == 100
    assert {s["repo_id"] for s in r.scores.collect()} == {"r1", "r2", "r3"}
    totals = {x["repo_id"]: x["n"] for x in r.severity_counts.groupBy("repo_id").agg(F.sum("n").alias("n")).collect()}
    assert totals == {x["repo_id"]: x["n_findings"] for x in r.scores.collect()}  # listed repos without findings count 0
    assert r.prioritized.count() == f.count()
    errs = {(e["path"], e["error"]) for e in r.errors.collect()}
    assert ("src/bad.py", "Syntax error at line 1: invalid syntax") in errs and ("pkg/d.py", "Pylint timeout") in errs
    fixable = f.filter("auto_fixable").count()
    assert r.fix_candidates.count() == fixable
    md = {x["repo_id"]: x["n"] for x in r.markdown.groupBy("repo_id").agg(F.count("*").alias("n")).collect()}
    assert md["r3"] == 2  # header + "No issues found."
    prog = {x["repo_id"]: (x["total_files"], x["files_analyzed"]) for x in r.progress.collect()}
    assert prog["r1"] == (3, 3)


def test_review_with_config_and_scope(spark):
    files = _files(spark)
    cfg = effective_config(spark.createDataFrame(
        [("r1", '{"severity_threshold": "high", "auto_fix": {"enabled": true}}'), ("r2", None)],
        "repo_id string, config_json string"))
    r = review(files, config=cfg, persist=False)
    sev = {x["severity"] for x in r.findings.filter(F.col("repo_id") == "r1").collect()}
    assert sev <= {"critical", "high"}
    sec = review(files, scope="security_only", persist=False).findings
    assert {x["category"] for x in sec.collect()} == {"security"}


def test_review_uses_the_whole_configuration(spark):
    files = files_df(spark, [("r1", "src/a.py", "import os\nos.system('x')\n"), ("r1", "vendor/v.py", "import os\nos.system('x')\n"),
                             ("r2", "vendor/v.py", "import os\nos.system('x')\n"), (None, "n.py", "eval('1')\n"),
                             ("r2", "deep/a.spec.py", "eval('1')\n"), ("r2", "x.js", "var a;")])
    cfg = effective_config(spark.createDataFrame(
        [("r1", '{"persona": "security", "severity_threshold": "info", "exclude_patterns": ["vendor/**", "**/*.spec.py"], '
                '"enabled_checks": ["security_audit", "static_analysis", "logic_verification"]}'),
         ("r2", '{"exclude_patterns": null, "severity_threshold": "info", "auto_fix": {"enabled": true}}')],
        "repo_id string, config_json string"))
    responses = spark.createDataFrame([("r1", "src/a.py", "looks wrong"), ("r1", "vendor/v.py", "never asked")],
                                      "repo_id string, path string, response string")
    requirements = spark.createDataFrame([("r1", "requirements.txt", "lib", "1.2.0")], "repo_id string, path string, name string, version string")
    advisories = spark.createDataFrame([("lib", "1.0.0", "2.0.0", "A-1", "critical")],
                                       "name string, lo string, hi string, advisory_id string, severity string")
    r = review(files, config=cfg, responses=responses, security_rules=DEFAULT_RULES, policy_rules=DEFAULT_POLICY_RULES,
               requirements=requirements, advisories=advisories, persist=False)
    got = {(f["repo_id"], f["file"], f["stage"], f["title"]) for f in r.findings.collect()}
    assert ("r1", "src/a.py", "security", "Shell command execution") in got
    assert ("r1", "requirements.txt", "security", "Vulnerable dependency: lib") in got
    assert ("r1", "src/a.py", "policy", "Policy rule broken: license-header") in got
    assert [f for f in got if f[2] == "logic"] == [("r1", "src/a.py", "logic", "Logic Intelligence Scan")]
    assert not [f for f in got if f[:2] == ("r1", "vendor/v.py")]  # excluded by its own configuration only
    assert {f[1] for f in got if f[0] == "r2"} >= {"vendor/v.py"} and {f[1] for f in got if f[0] is None} == {"n.py"}
    prompts = {(p["repo_id"], p["path"]): p["system_prompt"] for p in r.prompts.collect()}
    assert len(prompts) == 4 and len({prompts["r1", "src/a.py"], prompts["r2", "vendor/v.py"]}) == 2


def test_review_runs_analyzers_and_reports_broken_fixes(spark):
    from revline import registry

    def find(pdf):
        return pdf.assign(file=pdf["path"], line=1, severity="high", category="pattern", title="Odd\n)", description="d",
                          auto_fixable=True)

    registry.register_analyzer("odd", [".js"], find)
    try:
        r = review(_files(spark), persist=False)
        assert [f["file"] for f in r.findings.where("title LIKE 'Odd%'").collect()] == ["x.js"]
        assert r.errors.where("path IS NULL").count() == 1 and r.fixes.where("fix_code LIKE '%Odd%'").count() == 0
        approvals = r.fixes.select("issue_id").limit(1)
        assert review(_files(spark), approvals=approvals, persist=False).fixes.count() == 1
    finally:
        registry.unregister_analyzer("odd")


def test_globs_in_rows_match_globs_of_the_driver(spark):
    from revline.functions.glob import globs_regex, globs_to_regex
    globs = ["**/node_modules/**", "**/*.spec.py", "a?c/*.py", "x+(y)/[z].py", "end**"]
    rows = spark.createDataFrame([(globs,), ([],), (None,)], "g array<string>").select(globs_regex(F.col("g")).alias("x")).collect()
    paths = ["node_modules/a.py", "b/node_modules/c/d.py", "t.spec.py", "u/t.spec.py", "abc/d.py", "abc/d/e.py", "x+(y)/[z].py",
             "xx(y)/z.py", "ending/a.py", "legend.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    hits = lambda rx: sorted(r[0] for r in df.where(F.col("p").rlike(rx)).collect())
    assert hits(rows[0][0]) == hits(globs_to_regex(globs)) and len(hits(rows[0][0])) == 7 and rows[1][0] is rows[2][0] is None


def test_result_independent_of_partition_count(spark):
    from revline.operators import detectors as D
    files = _files(spark)
    a = sorted(D.review_findings(files, partitions=1).collect())
    b = sorted(D.review_findings(files.repartition(5), partitions=7).collect())
    assert a == b


def test_fixes_and_errors_partition_the_fixable(spark):
    from revline.operators import fixes as X
    from conftest import findings_df
    rows = [{"repo_id": "a", "file": "m.py", "line": i, "severity": "low", "category": "pattern",
             "title": f"T{i}" + ("\n)" if i % 3 == 0 else ""), "description": "d", "auto_fixable": i % 2 == 0,
             "stage": "pattern", "stage_order": 1, "seq": i} for i in range(30)]
    f = findings_df(spark, rows)
    cand = X.fix_candidates(f)
    ok = {r["issue_id"] for r in X.valid_fixes(cand).collect()}
    bad = {r["issue_id"] for r in X.fix_errors(cand).collect()}
    fixable = {r["id"] for r in f.filter("auto_fixable").collect()}
    assert ok | bad == fixable and not ok & bad and len(bad) == 5


def test_cli_review(spark, tmpdir_path, capsys):
    import os
    from revline.__main__ import main
    src = os.path.join(tmpdir_path, "proj")
    os.makedirs(src)
    open(os.path.join(src, "a.py"), "w").write("import os\nos.system('x')\n")
    open(os.path.join(src, "b.py"), "w").write('"""d"""\nx = 1\n')
    out = os.path.join(tmpdir_path, "reports")
    assert main(["review", src, "--repo-id", "p", "--format", "all", "--output", out]) == 0
    text = capsys.readouterr().out
    assert "Total Issues: 1" in text and "1. [HIGH] Unsafe system call" in text  # threshold medium
    assert main(["review", src, "--repo-id", "p", "--severity", "low", "--output", out]) == 0
    assert "Total Issues: 2" in capsys.readouterr().out
    assert os.path.isdir(os.path.join(out, "code_review_report.md", "repo_id=p"))


def test_scale_conf():
    from revline.session import scale_conf
    c = scale_conf(100 * 2**40, executors=1000, cores_per_executor=8)
    assert int(c["spark.sql.shuffle.partitions"]) == 819200  # 100 TB / 128 MB
    assert int(scale_conf(2**30, 10, 4)["spark.sql.shuffle.partitions"]) == 80  # two waves of 40 cores
