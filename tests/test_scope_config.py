"""Scope filters and the shallow config merge."""

import json

import pytest
from pyspark.sql import functions as F

from revline.functions.glob import glob_to_regex
from revline.operators import scope as B
from revline.sources import config as CFG

from conftest import findings_df


def _paths(spark, paths):
    return spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")


def test_extension_and_dir_markers(spark):
    df = _paths(spark, ["a.py", "src/b.py", ".github/c.py", "x/node_modules/d.py", "logs/e.py", "f.js", "g.pyc"])
    out = {r["path"] for r in B.exclude_dirs(B.python_files(df)).collect()}
    assert out == {"a.py", "src/b.py", "logs/e.py"}  # .git drops .github (substring rule)
    out2 = {r["path"] for r in B.exclude_dirs(B.python_files(df), B.FULL_PHASE_EXCLUDES).collect()}
    assert out2 == {"a.py", "src/b.py"}


def test_globs():
    import re
    rx = re.compile(glob_to_regex("**/node_modules/**"))
    assert rx.match("node_modules/x.py") and rx.match("a/node_modules/b/c.py") and not rx.match("anode_modules/x")
    rx2 = re.compile(glob_to_regex("**/*.spec.py"))
    assert rx2.match("x.spec.py") and rx2.match("a/b/x.spec.py") and not rx2.match("a/x.spec.py/y")


def test_exclude_globs_and_cap(spark):
    df = _paths(spark, ["vendor/a.py", "src/vendor/b.py", "t/x.test.js", "c.spec.py", "d.py", "e.py", "f.py"])
    kept = B.exclude_globs(df)
    assert {r["path"] for r in kept.collect()} == {"d.py", "e.py", "f.py"}
    assert [r["path"] for r in B.cap_files(kept, 2).orderBy("path").collect()] == ["d.py", "e.py"]


def test_select_scope(spark):
    df = _paths(spark, ["a.py", "b.py", "c.py"])
    assert {r["path"] for r in B.select_scope(df, "files", ["b.py"]).collect()} == {"b.py"}
    changed = _paths(spark, ["c.py", "z.py"])
    assert {r["path"] for r in B.select_scope(df, "diff", changed=changed).collect()} == {"c.py"}
    assert B.select_scope(df, "full").count() == 3


def _cfg(spark, docs):
    rc = spark.createDataFrame([(k, None if v is None else json.dumps(v) if not isinstance(v, str) else v)
                                for k, v in docs.items()], "repo_id string, config_json string")
    return {r["repo_id"]: r for r in CFG.effective_config(rc).collect()}


def test_shallow_merge(spark):
    got = _cfg(spark, {"d": None, "u": {"auto_fix": {"enabled": False}, "severity_threshold": "high"},
                       "n": '{"severity_threshold": null}', "bad": "not json"})
    assert got["d"]["severity_threshold"] == "medium" and got["d"]["auto_fix"]["safe_only"] is True
    assert len(got["d"]["enabled_checks"]) == 6 and got["d"]["max_analysis_time"] == 600
    assert got["u"]["auto_fix"]["enabled"] is False and got["u"]["auto_fix"]["safe_only"] is None
    assert got["u"]["severity_threshold"] == "high"
    assert got["n"]["severity_threshold"] is None
    assert got["bad"]["severity_threshold"] == "medium"


def test_src_defaults(spark):
    rc = spark.createDataFrame([("x", None)], "repo_id string, config_json string")
    r = CFG.effective_config(rc, "src").collect()[0]
    assert r["enabled_checks"] == ["static_analysis", "security_audit", "performance_analysis"]
    assert r["auto_fix"]["enabled"] is True and r["auto_fix"]["safe_only"] is None


def test_apply_config_threshold_checks_and_skip(spark):
    f = findings_df(spark, [
        {"repo_id": "a", "file": "x", "line": 1, "severity": s, "category": c, "title": s + c, "description": "",
         "auto_fixable": False, "stage": st, "stage_order": 0, "seq": i}
        for i, (s, c, st) in enumerate([("high", "security", "security"), ("low", "security", "security"),
                                        ("high", "style", "static"), ("warning", "style", "static"),
                                        ("critical", "logic", "logic")])])
    cfg = spark.createDataFrame([("a", "medium", ["security_audit", "static_analysis"], ["style"])],
                                "repo_id string, severity_threshold string, enabled_checks array<string>, "
                                "skip_categories array<string>")
    got = {r["title"] for r in B.apply_config(f, cfg).collect()}
    assert got == {"highsecurity"}
    cfg_info = cfg.withColumn("severity_threshold", F.lit("info")).withColumn("skip_categories", F.array())
    got2 = {r["title"] for r in B.apply_config(f, cfg_info).collect()}
    assert got2 == {"highsecurity", "lowsecurity", "highstyle", "warningstyle"}


def test_yaml_parse():
    yaml = pytest.importorskip("yaml")
    assert CFG.parse_yaml_config("") == {}
    assert CFG.parse_yaml_config("severity_threshold: high\n") == {"severity_threshold": "high"}
    assert CFG.parse_yaml_config("a: [1") == {}
    with pytest.raises(yaml.YAMLError):
        CFG.parse_yaml_config("a: [1", variant="src")


def test_yaml_files_in_a_table(spark):
    pytest.importorskip("yaml")
    texts = {"a": "severity_threshold: high\nauto_fix:\n  enabled: no\nskip_categories: [style, 2]\n", "b": "a: [1", "c": "", "d": None, "e": "- x\n- y",
             "f": "# only a comment", "g": "when: 2024-01-01\npersona: mentor\n1: one"}
    read = CFG.configs_from_yaml(spark.createDataFrame(list(texts.items()), "repo_id string, config_yaml string"))
    assert {r.repo_id for r in CFG.yaml_errors(read).collect()} == {"b", "e"}
    got = {r.repo_id: r for r in CFG.effective_config(read).collect()}
    assert got["a"].severity_threshold == "high" and got["a"].auto_fix.enabled is False and got["a"].auto_fix.safe_only is None
    assert got["a"].skip_categories == ["style", "2"] and got["g"].persona == "mentor"
    for repo in "bcdef":
        assert got[repo].severity_threshold == "medium" and got[repo].auto_fix.safe_only is True
