"""A1–A5 sources, G1–G5 streaming (stream = batch), H1 registry."""

import os

import pandas as pd
from pyspark.sql import functions as F

from revline import registry
from revline.operators import detectors as D
from revline.sources import files as SF
from revline.sources import reports as REP
from revline.streaming import fold as G
from revline.streaming import incremental as GI

from conftest import files_df


def test_scan_corpus(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "repo")
    os.makedirs(os.path.join(root, "pkg"))
    open(os.path.join(root, "a.py"), "w").write("x = 1\r\n")
    open(os.path.join(root, "pkg", "b.py"), "w").write("def f():\n    pass\n")
    open(os.path.join(root, "pkg", "c.txt"), "w").write("not python")
    open(os.path.join(root, "empty.py"), "w").write("")
    with open(os.path.join(root, "bad.py"), "wb") as fh:
        fh.write(b"x = '\xff'\n")
    got = {r["path"]: r for r in SF.scan_corpus(spark, root, repo_id="r1").collect()}
    assert set(got) == {"a.py", "pkg/b.py", "bad.py"}  # zero-byte files are skipped by Spark (T5)
    assert got["a.py"]["content"] == "x = 1\n" and got["bad.py"]["error"] == "invalid UTF-8"
    ign = {r["path"]: r for r in SF.scan_corpus(spark, root, errors="ignore").collect()}
    assert ign["bad.py"]["content"] == "x = ''\n" and ign["bad.py"]["error"] is None


def test_load_policies_wholetext(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "standards")
    os.makedirs(d)
    open(os.path.join(d, "p.txt"), "w").write("line one\nline two\n")
    rows = SF.load_policies(spark, d).collect()
    assert len(rows) == 1 and rows[0]["text"] == "line one\nline two\n"


def test_lint_ingest(spark):
    rep = spark.createDataFrame([
        ("a.py", '[{"path": "a.py", "line": 3, "column": 0, "type": "convention", "message": "m", '
                 '"message-id": "C0114", "symbol": "missing-docstring"}, {"path": "a.py", "message": "x"}]'),
        ("b.py", '{"error": "Pylint timeout"}'), ("c.py", "[]")], "path string, report string")
    issues = REP.ingest_lint(rep)
    f = {(r["line"], r["severity"], r["title"]) for r in REP.lint_findings(issues).collect()}
    assert f == {(3, "convention", "Lint Issue: missing-docstring"), (0, "medium", "Lint Issue: None")}
    assert [r["error"] for r in REP.lint_errors(issues).collect()] == ["Pylint timeout"]
    strict = REP.lint_findings(issues, strict_parity=True).count()
    assert strict == 3


def test_complexity_ingest_one_failure_does_not_null_the_rest(spark):
    rep = spark.createDataFrame([
        ("a.py", '{"a.py": [{"name": "f", "lineno": 1, "complexity": 12}], "b.py": {"error": "x"}}'),
        ("b.py", '{"a.py": [], "b.py": {"error": "bad"}}'), ("c.py", '{"other.py": []}')], "path string, report string")
    blocks = REP.ingest_complexity(rep)
    rows = {(r["path"], r["name"], r["complexity"], r["error"]) for r in blocks.collect()}
    assert rows == {("a.py", "f", 12, None), ("b.py", None, None, "bad")}
    f = REP.complexity_report_findings(blocks).collect()
    assert [(r["file"], r["description"]) for r in f] == [("a.py", "Function f has complexity 12")]


def _events(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    rows = [("u1", t + dt.timedelta(seconds=i), i, "static_analysis_complete" if i % 2 else "scope_defined", i % 3)
            for i in range(10)] + [("u2", t, 100, "reporting_complete", 1)]
    return spark.createDataFrame(rows, "run_id string, ts timestamp, event_id long, current_step string, files_delta int")


def test_fold_runs(spark):
    got = {r["run_id"]: r for r in G.step_labels(G.fold_runs(_events(spark))).collect()}
    assert got["u1"]["current_step"] == "static_analysis_complete" and got["u1"]["n_events"] == 10
    assert got["u1"]["step_label"] == "Static Analysis Complete"
    assert got["u1"]["files_analyzed"] == sum(i % 3 for i in range(10))


def test_stream_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "events_in")
    ev = _events(spark)
    ev.repartition(3).write.parquet(src)
    want = sorted(G.fold_runs(ev).collect())
    for mode in ("update", "complete"):
        stream = GI.stream_file_table(spark, src, ev.schema, max_files_per_trigger=1)
        out = GI.run_to_table(spark, G.fold_runs(stream), "t", mode=mode, keys=["run_id"])
        assert sorted(out.select(*G.fold_runs(ev).columns).collect()) == want


def test_stream_review_scores(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "files_in")
    files = files_df(spark, [("r", "a.py", "import os\nos.system('x')"), ("r", "b.py", "x = 100"),
                             ("s", "c.py", '"""d"""\nx = 1')])
    files.write.parquet(src)
    stream = GI.stream_file_table(spark, src, files.schema)
    out = GI.run_to_table(spark, GI.running_scores(D.review_findings(stream)), "s", keys=["repo_id"])
    batch = GI.running_scores(D.review_findings(files))
    assert sorted(out.collect()) == sorted(batch.collect())


def test_run_check(spark):
    pf = spark.createDataFrame([(2, "b", "d2"), (1, "a", "d1")], "doc_id long, file string, description string")
    r = G.run_check(pf).collect()[0]
    assert (r["n_policy_findings"], r["first_file"]) == (2, "a")


def test_registry(spark):
    def todo(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for repo, path, content in zip(pdf["repo_id"], pdf["path"], pdf["content"]):
            for i, line in enumerate(content.split("\n"), 1):
                if "TODO" in line:
                    rows.append({"repo_id": repo, "file": path, "line": i, "severity": "info", "category": "style",
                                 "title": "TODO", "description": line.strip(), "auto_fixable": False})
        return pd.DataFrame(rows)
    registry.register_analyzer("todo", [".py"], todo)
    try:
        files = files_df(spark, [("r", "a.py", "x = 1  # TODO fix\n"), ("r", "b.java", "class A {}"),
                                 ("r", "c.md", "TODO")])
        out = registry.run_analyzers(files)
        assert [(r["file"], r["line"], r["title"]) for r in out.collect()] == [("a.py", 1, "TODO")]
        assert "java" in registry.analyzers() and out.filter(F.col("id").isNull()).count() == 0
    finally:
        registry.unregister_analyzer("todo")


def test_languages_and_frameworks(spark):
    from revline.operators import languages as L
    files = spark.createDataFrame([("r", "a.py"), ("r", "b.py"), ("r", "c.ts"), ("r", "d.tsx"), ("r", "e.ts"),
                                   ("r", "f.md"), ("s", "g.java")], "repo_id string, path string")
    counts = {(x["repo_id"], x["language"]): x["n_files"] for x in L.language_counts(files).collect()}
    assert counts == {("r", "python"): 2, ("r", "typescript"): 3, ("r", "other"): 1, ("s", "java"): 1}
    prim = {x["repo_id"]: x["primary_language"] for x in L.primary_language(files).collect()}
    assert prim == {"r": "typescript", "s": "java"}
    imports = spark.createDataFrame([("r", "django.db"), ("r", "os"), ("r", "pandas"), ("s", "flask")],
                                    "repo_id string, module string")
    fw = {x["repo_id"]: x["frameworks"] for x in L.frameworks(imports).collect()}
    assert fw == {"r": ["Django", "pandas"], "s": ["Flask"]}


def test_stream_scores_replace_the_findings_of_a_pushed_file(spark, tmpdir_path):
    import os
    from pyspark.sql import functions as F
    from revline.operators import detectors as D
    from revline.streaming import incremental as GI
    schema = "repo_id string, path string, content string, version int"
    bad, good = "import os\nos.system('x')\n", '"""d"""\nx = 1\n'
    pushes = [[("r", "a.py", bad, 1), ("r", "b.py", bad, 1), (None, "n.py", bad, 1), ("s", "c.py", bad, 1), ("s", "c.py", good, 2)],
              [("r", "a.py", good, 2), ("r", "b.py", bad, 2)]]
    folder = os.path.join(tmpdir_path, "pushes")
    for i, rows in enumerate(pushes):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        os.utime(next(os.path.join(folder, f) for f in sorted(os.listdir(folder), key=lambda f: os.path.getmtime(os.path.join(folder, f)))[::-1]
                      if f.endswith(".parquet")), (1_700_000_000 + i, 1_700_000_000 + i))
    stream = GI.stream_file_table(spark, folder, schema, max_files_per_trigger=1)
    got = {r["repo_id"]: (r["n_findings"], r["score"]) for r in GI.run_reviews(spark, stream, "pushes", version="version").collect()}
    final = spark.createDataFrame([("r", "a.py", good), ("r", "b.py", bad), (None, "n.py", bad), ("s", "c.py", good)],
                                  "repo_id string, path string, content string")
    batch = {r["repo_id"]: (r["n_findings"], r["score"]) for r in GI.running_scores(D.review_findings(final)).collect()}
    assert got == {"s": (0, 100)} | batch and got["r"][0] == batch["r"][0] > 0
