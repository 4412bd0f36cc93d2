"""The per-file parser (pure Python part) and its Spark wrapper."""

from revline.operators import facts as C
from revline.operators.detectors import file_facts
from revline.operators.facts import explode_classes, explode_imports, is_valid_python, parse_source
from revline.operators.rules import DEFAULT_RULES
from revline.plans.review import review
from revline.sources.config import effective_config

from conftest import files_df


def test_length_is_end_minus_start():
    src = "def tally(rows):\n    total = 0\n" + "    total += len(rows)\n" * 68 + "    return total\n"
    f = parse_source(src)["functions"][0]
    assert f["end_line"] - f["line"] == 70


def test_nested_ifs_complexity_at_least_four():
    src = """
def shipping(order):
    fee = 0
    if order.weight:
        fee = 4
        if order.abroad:
            fee = 9
            if order.express:
                fee = 20
    return fee
"""
    f = parse_source(src)["functions"][0]
    assert f["complexity"] >= 4
    assert f["complexity"] == 4


def test_complexity_rule_parts():
    src = """
def g(a, b):
    for x in a:
        pass
    else:
        pass
    while b and a or x:
        pass
    try:
        pass
    except ValueError:
        pass
    y = [i for i in a if i if i > 1]
    z = 1 if a else 2
    assert a
    def inner():
        if a:
            pass
    return y
"""
    fns = {f["name"]: f for f in parse_source(src)["functions"]}
    # 1 + for(1+else) + while 1 + boolops (and:1, or:1) + except 1 + comprehension (1+2) + ifexp 1 + assert 1
    assert fns["g"]["complexity"] == 1 + 2 + 1 + 2 + 1 + 3 + 1 + 1
    assert fns["inner"]["complexity"] == 2


def test_async_functions_flagged_and_args_only_positional():
    src = "async def a(x):\n    pass\n\ndef b(p, /, q, *r, s, **t):\n    pass\n"
    fns = {f["name"]: f for f in parse_source(src)["functions"]}
    assert fns["a"]["is_async"] is True
    assert fns["b"]["args"] == ["q"]  # node.args.args only


def test_decorators_and_classes_and_imports():
    src = ("import os, sys as system\nfrom a.b import c\nfrom . import d\n"
           "@staticmethod\n@x.y(1)\ndef f():\n    pass\n"
           "class K:\n    def m(self):\n        pass\n    async def n(self):\n        pass\n")
    r = parse_source(src)
    names = [(i["module"], i["name"], i["alias"], i["level"], i["nth"], i["line"]) for i in r["imports"]]
    assert names == [("os", None, None, 0, 0, 1), ("sys", None, "system", 0, 1, 1), ("a.b", "c", None, 0, 0, 2), ("", "d", None, 1, 0, 3)]
    f = [x for x in r["functions"] if x["name"] == "f"][0]
    assert f["decorators"] == ["staticmethod", "x.y(1)"]
    k = r["classes"][0]
    assert k["name"] == "K" and [(x["name"], x["owner"]) for x in r["functions"]] == [("f", None), ("m", 0), ("n", 0)]


def test_methods_and_modules_from_their_records(spark):
    src = ("import os, sys\nfrom a import b, c\nclass A:\n    def m(self):\n        def inner():\n            pass\n    if 1:\n        def hidden(self):\n"
           "            pass\n    class B:\n        def k(self):\n            pass\n    def n(self):\n        pass\ndef free():\n    pass\n")
    facts = file_facts(files_df(spark, [("r", "a.py", src), ("r", "bad.py", "def f(:")]))
    assert {r["name"]: r["methods"] for r in explode_classes(facts).collect()} == {"A": ["m", "n"], "B": ["k"]}
    assert [r["module"] for r in explode_imports(facts).collect()] == ["os", "sys", "a"]


def test_building_a_review_runs_no_job(spark):
    files = files_df(spark, [("r", "a.py", "x = 1\n"), ("r", "b.java", "eval(1)")])
    changed = files.select("repo_id", "path").distinct()
    config = effective_config(spark.createDataFrame([("r", None)], "repo_id string, config_json string"), "root")
    sc = spark.sparkContext
    sc.setJobGroup("build", "build")
    try:
        r = review(files, scope="diff", changed=changed, config=config, security_rules=DEFAULT_RULES, persist=False)
        assert not sc.statusTracker().getJobIdsForGroup("build")
        assert r.findings.count() > 0
    finally:
        sc._jsc.clearJobGroup()


def test_syntax_error_message_and_other_errors():
    r = parse_source("def f(:")
    assert r["status"] == "error"
    assert r["error"] == "Syntax error at line 1: invalid syntax"
    assert parse_source("x = 1\x00")["status"] == "error"
    assert parse_source(None)["status"] == "error"
    assert not is_valid_python("def f(:")
    assert is_valid_python("# Fixed x\ndef fixed_function():\n    pass")
    assert not is_valid_python("# Fixed x\n)\ndef fixed_function():\n    pass")


def test_calls_with_loop_depth():
    src = "def f(db):\n    for r in rows:\n        db.execute(r)\n    db.commit()\n    [q.query() for q in r]\n"
    calls = {(c["name"], c["loop_depth"]) for c in parse_source(src)["calls"]}
    assert ("db.execute", 1) in calls and ("db.commit", 0) in calls and ("q.query", 1) in calls


def test_node_count_matches_ast_walk():
    import ast
    src = "import os\ndef f(a, b=1):\n    return [x + a for x in range(b) if x]\nclass C:\n    y: int = 2\n"
    assert parse_source(src)["node_count"] == sum(1 for _ in ast.walk(ast.parse(src)))


def test_parse_files_spark(spark):
    df = files_df(spark, [("r", "a.py", "def f(a):\n    return a\n"), ("r", "b.py", "def f(:")])
    facts = C.parse_files(df)
    rows = {r["path"]: r for r in facts.collect()}
    assert rows["a.py"]["status"] == "success" and rows["a.py"]["functions"][0]["name"] == "f"
    assert rows["b.py"]["status"] == "error"
    assert "content" not in facts.columns
    errs = C.parse_errors(facts).collect()
    assert [e["path"] for e in errs] == ["b.py"]


def test_memo_is_bounded_by_what_its_facts_take(monkeypatch):
    import tracemalloc

    from revline.operators import facts as C
    monkeypatch.setattr(C, "MEMO_BYTES", 1 << 20)
    memo = C._Memo()
    tracemalloc.start()
    for i in range(6000):  # short texts, whose facts are many times as large
        memo(f"def f{i}(a, b):\n    for x in a:\n        b.execute(x)\n")
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 4 << 20 and memo.facts
    assert memo("def f5999(a, b):\n    for x in a:\n        b.execute(x)\n")["calls"][0]["name"] == "b.execute"
