"""F1–F4 line reports, A7 sinks, A8 payloads."""

import glob
import json
import os

from revline.plans import reports as RP
from revline.sources import sinks

from conftest import findings_df


def _f(repo, sev, seq, title):
    return {"repo_id": repo, "file": "m.py", "line": seq, "severity": sev, "category": "style", "title": title,
            "description": "d" + title, "auto_fixable": False, "stage": "static", "stage_order": 0, "seq": seq}


def _text(lines, repo):
    return "".join(r["text"] for r in lines.filter(lines.repo_id == repo).orderBy("pos").collect())


def test_markdown_matches_reference_format(spark):
    f = findings_df(spark, [_f("a", "low", 1, "L"), _f("a", "critical", 2, "C")])
    repos = spark.createDataFrame([("a",), ("empty",)], "repo_id string")
    lines = RP.markdown_lines(f, repos)
    assert _text(lines, "a") == ("# Code Review Report\n\n"
                                 "## C\n- **Severity**: critical\n- **File**: m.py\n- **Description**: dC\n\n"
                                 "## L\n- **Severity**: low\n- **File**: m.py\n- **Description**: dL\n\n")
    assert _text(lines, "empty") == "# Code Review Report\n\nNo issues found."


def test_json_lines_form_a_document(spark):
    f = findings_df(spark, [_f("a", "low", 1, "L"), _f("a", "high", 2, "H")])
    repos = spark.createDataFrame([("a",), ("e",)], "repo_id string")
    lines = RP.json_lines(f, repos)
    doc = json.loads(_text(lines, "a"))
    assert doc["summary"] == "Analysis complete" and [x["title"] for x in doc["findings"]] == ["H", "L"]
    assert json.loads(_text(lines, "e")) == {"findings": [], "summary": "Analysis complete"}


def test_bootstrap_and_full_phase(spark):
    f = findings_df(spark, [_f("a", "low", 1, "L"), _f("a", "high", 2, "H"), _f("a", "medium", 3, "M")])
    boot = _text(RP.bootstrap_lines(f), "a")
    assert boot.startswith("# Review Report\n\n## Findings\n### L (LOW)\n- **File**: m.py")
    full = _text(RP.full_phase_lines(f, "DATE"), "a")
    assert "- Total Findings: 3\n- Critical: 0\n- High: 1\n- Medium: 1\n- Low: 1\n" in full
    assert full.index("### H [HIGH]") < full.index("### L [LOW]") < full.index("### M [MEDIUM]")


def test_write_report_round_trip(spark, tmpdir_path):
    f = findings_df(spark, [_f("a", "low", i, f"T{i}") for i in range(50)] + [_f("b", "high", 1, "B")])
    lines = RP.markdown_lines(f)
    out = os.path.join(tmpdir_path, "md")
    sinks.write_report(lines, out, partitions=4)
    for repo in ("a", "b"):
        parts = sorted(glob.glob(os.path.join(out, f"repo_id={repo}", "part-*")))
        text = "".join(open(p).read() for p in parts)
        assert text == _text(lines, repo)
    assert sinks.write_reports(lines, None, tmpdir_path + "/r", "html") == []


def test_findings_sink_partitioned(spark, tmpdir_path):
    f = findings_df(spark, [_f("a", "low", 1, "L"), _f("b", "low", 1, "L")])
    sinks.write_findings(f, tmpdir_path + "/f", buckets=4)
    back = spark.read.parquet(tmpdir_path + "/f")
    assert back.count() == 2 and "repo_bucket" in back.columns


def test_hot_repo_reports_equal_plain_window(spark):
    """One repo with most findings: the range-split path gives the same report lines."""
    rows = [_f("hot", ["low", "high", "medium"][i % 3], i, f"T{i}") for i in range(400)] + \
           [_f(f"r{i}", "low", i, "x") for i in range(20)]
    f = findings_df(spark, rows)
    plain = sorted(RP.markdown_lines(f).collect())
    spark.conf.set("revline.positions.hotRows", "50")
    try:
        split = sorted(RP.markdown_lines(f).collect())
        js = RP.json_lines(f)
        doc = json.loads(_text(js, "hot"))
    finally:
        spark.conf.unset("revline.positions.hotRows")
    assert split == plain and len(doc["findings"]) == 400
