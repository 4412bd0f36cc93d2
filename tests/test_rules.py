"""Secrets, rule scan, advisories, policy rules."""

from revline.operators import rules as R


def test_secret_mask_boundaries(spark):
    docs = spark.createDataFrame([
        (1, "a sk-" + "a" * 31 + " b"), (2, "a sk-" + "b" * 32 + " b"),
        (3, "key=" + "c" * 19), (4, "url?key=" + "d-_" * 7 + "!"), (5, "plain")], "doc_id long, text string")
    got = {r["doc_id"]: r["masked_text"] for r in R.masked(docs).collect()}
    assert got[1] == "a sk-" + "a" * 31 + " b"
    assert got[2] == "a sk-******** b"
    assert got[3] == "key=" + "c" * 19
    assert got[4] == "url?key=********!"
    assert got[5] == "plain"
    counts = {(r["doc_id"], r["kind"]): r["n"] for r in R.secret_counts(docs).collect()}
    assert counts == {(2, "sk_token"): 1, (4, "key_param"): 1}


def test_mask_matches_python_re():
    import re
    from revline.functions.text import SECRET_PATTERNS
    text = "x sk-" + "Z9" * 20 + " key=" + "ab-_" * 6
    out = text
    for _, p in SECRET_PATTERNS:
        out = re.sub(p, r"\1********", out)
    assert out == "x sk-******** key=********"


def test_scan_rules_lines(spark):
    docs = spark.createDataFrame([(1, "ok\ntoken = \"" + "a" * 40 + "\"\nos.system('x')\r\neval(y)"), (2, "nothing")],
                                 "doc_id long, text string")
    got = sorted((r["doc_id"], r["line_no"], r["rule_id"]) for r in R.scan_rules(docs).collect())
    assert got == [(1, 2, "hardcoded-token"), (1, 3, "os-system"), (1, 4, "eval-call")]


def test_advisory_ranges(spark):
    req = spark.createDataFrame([("p", "1.2.3", "a"), ("p", "1.10.0", "b"), ("p", "2.0.0", "c"), ("q", "1.2.3", "d")],
                                "name string, version string, path string")
    adv = spark.createDataFrame([("p", "A1", "1.2.0", "1.10.0", "high")],
                                "name string, advisory_id string, lo string, hi string, severity string")
    got = sorted(r["path"] for r in R.advisory_hits(req, adv).collect())
    assert got == ["a"]  # 1.10.0 is not below hi (numeric, not string, order)


def test_policy_violations(spark):
    docs = spark.createDataFrame([(1, "MIT License\nx"), (2, "no header"), (3, 'License\ntoken = "' + "f" * 40 + '"')],
                                 "doc_id long, text string")
    got = sorted((r["doc_id"], r["rule_id"]) for r in R.policy_violations(docs).collect())
    assert got == [(2, "license-header"), (3, "no-hardcoded-token")]
