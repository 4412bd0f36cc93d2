"""Rules in a table against the same rules as a list and against a plain scan."""

import random
import re

from revline.operators import rule_tables, rules
from revline.plans.review import review

from conftest import files_df

DOCS = [(1, "a = 1\npassword = 'x'\r\nos.system('ls')\n\nsk-" + "a" * 32), (2, None), (3, ""), (4, "token = \"" + "0f" * 20 + "\""),
        (5, "eval(x); eval(y)"), (6, "key=" + "b" * 25 + " 😀 naïve"), (None, "eval(z)"), (7, "ab"), (7, "no match\neval(q)")]
SCHEMA = "doc_id long, text string"


def test_table_equals_list(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    own = [*rules.DEFAULT_RULES, {"rule_id": "blank", "regex": "^$", "severity": "low", "cwe_id": None, "title": "Blank"},
           {"rule_id": "short", "regex": "a.?b", "literal": "b", "severity": "low", "cwe_id": None, "title": "Short literal"},
           {"rule_id": "smile", "regex": "\\x{1F600} n", "literal": "😀 n", "severity": "low", "cwe_id": None, "title": "Sign"}]
    for r in own:
        r.setdefault("literal", None)
    table = rule_tables.rule_table(spark, own)
    table = table.unionAll(table.limit(2)).unionAll(spark.createDataFrame([(None, "x", None, "low", None, "none"), ("null", None, None, "low", None, "none")],
                                                                         rule_tables.RULE_SCHEMA))
    got = sorted(map(str, rule_tables.scan_rule_table(docs, table).collect()))
    assert got == sorted(map(str, rules.scan_rules(docs, own).collect())) and len(got) > 8
    assert rule_tables.scan_rule_table(docs, table.where("false")).count() == 0
    assert rule_tables.scan_rule_table(docs.where("false"), table).count() == 0


def test_ten_thousand_rules(spark, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9))) for _ in range(10_000)]
    table = spark.createDataFrame([(f"r{i}", f"\\b{w}\\b", w if i % 200 else None, "low", "CWE-0", w) for i, w in enumerate(words)], rule_tables.RULE_SCHEMA)
    docs = [(i, "\n".join(" ".join(rng.choice(words) + rng.choice(["", "x"]) for _ in range(6)) for _ in range(5))) for i in range(120)]
    by_word = {}
    for i, w in enumerate(words):
        by_word.setdefault(w, []).append(f"r{i}")
    want = {(d, n + 1, r) for d, t in docs for n, line in enumerate(t.split("\n")) for w in line.split() for r in by_word.get(w, [])}
    df = spark.createDataFrame(docs, SCHEMA)
    found = rule_tables.scan_rule_table(df, table)
    assert found._jdf.queryExecution().analyzed().toString().count("r9999") == 0  # no expression for a rule
    assert {(r.doc_id, r.line_no, r.rule_id) for r in found.collect()} == want and want
    monkeypatch.setattr(rule_tables, "HELD_ROWS", 0)  # the rules too many to copy
    assert {(r.doc_id, r.line_no, r.rule_id) for r in rule_tables.scan_rule_table(df, table).collect()} == want


def test_policy_table(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    table = spark.createDataFrame([("must", "eval", None, "eval"), ("must2", "(?s)a.*=", None, None), ("bar", None, "os.system", "os.s"), (None, "x", None, None)],
                                  "rule_id string, must_match string, must_not_match string, literal string")
    want = []
    for i, t in DOCS:
        want += [(i, "must")] * (not re.search("eval", t or "")) + [(i, "must2")] * (not re.search("(?s)a.*=", t or "")) + [(i, "bar")] * ("os.system" in (t or ""))
    got = [tuple(r) for r in rule_tables.violations(docs, table).collect()]
    # rows that repeat an id are told by the id
    assert {x for x in got if x[0] != 7} == {x for x in want if x[0] != 7}


def test_review_scans_every_known_language(spark):
    files = files_df(spark, [("r", "src/A.java", "eval(1)"), ("r", "web/b.ts", "x\neval(2)"), ("r", "c.py", "eval(3)"), ("r", "notes.md", "eval(4)")])
    table = rule_tables.rule_table(spark, rules.DEFAULT_RULES)
    for given in (rules.DEFAULT_RULES, table):
        found = review(files, security_rules=given, persist=False).findings.where("stage = 'security' and title = 'Use of eval'")
        assert {(r.file, r.line) for r in found.collect()} == {("src/A.java", 1), ("web/b.ts", 2), ("c.py", 1)}
