"""Detector rules at their boundaries (strict limits, as in the reference)."""

from pyspark.sql import functions as F

from revline.operators import detectors as D

from conftest import files_df


def _fn(n_body):
    return "def f(a):\n" + "\n".join(["    y = 0"] * n_body)


def _titles(df):
    return sorted((r["file"], r["title"]) for r in df.select("file", "title").collect())


def test_thresholds(spark):
    rows = [
        ("r", "f50.py", '"""d"""\n' + _fn(50)),  # length 50: not long
        ("r", "f51.py", '"""d"""\n' + _fn(51)),  # length 51: long
        ("r", "p5.py", '"""d"""\ndef f(a,b,c,d,e):\n    pass'),
        ("r", "p6.py", '"""d"""\ndef f(a,b,c,d,e,g):\n    pass'),
        ("r", "c500.py", '"""d"""\nclass C:\n' + "\n".join(["    y = 0"] * 500)),
        ("r", "c501.py", '"""d"""\nclass C:\n' + "\n".join(["    y = 0"] * 501)),
    ]
    out = D.review_findings(files_df(spark, rows), D.SMELL_DETECTORS)
    assert _titles(out) == [("c501.py", "God Class"), ("f51.py", "Long Function"), ("p6.py", "Too Many Parameters")]
    msgs = {r["file"]: r["description"] for r in out.collect()}
    assert msgs["f51.py"] == "Function 'f' is 51 lines long (>50)"
    assert msgs["p6.py"] == "Function 'f' has 6 parameters (>5)"
    assert msgs["c501.py"] == "Class 'C' is 501 lines long (>500)"
    r = out.filter(F.col("file") == "f51.py").collect()[0]
    assert (r["severity"], r["category"], r["auto_fixable"], r["line"]) == ("medium", "pattern", True, 2)


def test_complexity_boundary(spark):
    def nested(m):
        return "def f(a):\n" + "".join(" " * (4 * j) + "if a:\n" for j in range(1, m + 1)) + " " * (4 * (m + 1)) + "pass"
    out = D.review_findings(files_df(spark, [("r", "c10.py", nested(9)), ("r", "c11.py", nested(10))]), ["complexity"])
    rows = out.collect()
    assert [(r["file"], r["description"], r["severity"]) for r in rows] == \
        [("c11.py", "Function f has complexity 11", "high")]


def test_magic_numbers_per_line_and_only_if_parsed(spark):
    src = '"""d"""\nx = 100\ny = 3600 + 86400  # two numbers, one finding\nz = 5\n# 1000 in a comment'
    out = D.review_findings(files_df(spark, [("r", "m.py", src), ("r", "bad.py", "x = 100\ndef f(:")]),
                            ["magic_number"])
    assert sorted((r["file"], r["line"]) for r in out.collect()) == [("m.py", 2), ("m.py", 3), ("m.py", 5)]


def test_script_rules_and_crlf(spark):
    rows = [("r", "u.py", "import os\nos.system('ls')"), ("r", "short.py", "x = 1"),
            ("r", "eleven.py", "x = 1234567"), ("r", "doc.py", "'''doc'''\r\nx = 1\r\n")]
    out = D.review_findings(files_df(spark, rows), ["unsafe_call", "missing_docstring"])
    got = sorted((r["file"], r["title"]) for r in out.collect())
    assert got == [("eleven.py", "Missing docstring"), ("u.py", "Missing docstring"), ("u.py", "Unsafe system call")]


def test_crlf_lines_match_lf(spark):
    body = "\r\n".join(["    y = 0"] * 60)
    out = D.review_findings(files_df(spark, [("r", "w.py", '"""d"""\r\ndef g(a):\r\n' + body)]), ["long_function"])
    assert out.collect()[0]["description"] == "Function 'g' is 60 lines long (>50)"


def test_reference_integration_fixture(spark):
    # integration case: a long function with a comment and 60 `pass` lines
    src = ("def vulnerable_function(user_input):\n    query = f\"SELECT * FROM users WHERE id = {user_input}\"\n"
           "    return query\n\n\ndef long_function():\n    # This function is too long\n"
           + "\n".join(["    pass"] * 60) + "\n")
    out = D.review_findings(files_df(spark, [("repo", "demo/app.py", src)]))
    titles = [r["title"] for r in out.collect()]
    assert "Long Function" in titles and len(titles) >= 1
    long = [r for r in out.collect() if r["title"] == "Long Function"][0]
    assert long["line"] == 6 and "61 lines" in long["description"]


def test_ids_are_deterministic(spark):
    rows = [("r", "u.py", "import os\nos.system('ls')")]
    a = D.review_findings(files_df(spark, rows)).select("id").collect()
    b = D.review_findings(files_df(spark, rows)).select("id").collect()
    assert a == b and len(a[0]["id"]) == 64


def test_n_plus_one(spark):
    src = "def f(db, rows):\n    for r in rows:\n        db.execute(r)\n    db.execute('x')\n"
    facts = D.file_facts(files_df(spark, [("r", "q.py", src)]))
    out = D.n_plus_one(facts).collect()
    assert [(r["line"], r["category"]) for r in out] == [(3, "performance")]


def test_null_content_becomes_an_error_row(spark):
    from revline.operators.facts import parse_errors
    df = spark.createDataFrame([("r", "a.py", None), ("r", "b.py", None), ("r", "c.py", "x = 1")],
                               "repo_id string, path string, content string")
    facts = D.file_facts(df)
    assert facts.count() == 3
    assert sorted((e["path"], e["error"]) for e in parse_errors(facts).collect()) == \
        [("a.py", "unreadable file"), ("b.py", "unreadable file")]
