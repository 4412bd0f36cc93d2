"""Comments and strings of three languages, and rules kept to places."""

from revline.operators.lexer import spans
from revline.operators.rules import DEFAULT_RULES
from revline.plans.review import review

from conftest import files_df


def told(text, language):
    return [(text[a:b], k[0]) for a, b, k in spans(text, language)]


def test_spans():
    python = "a = 'x#y' # c 'd'\nb = '''m\n'n' # o''' + \"p\\\"q\" + 'open\nr"
    assert told(python, "python") == [("'x#y'", "s"), ("# c 'd'", "c"), ("'''m\n'n' # o'''", "s"), ('"p\\"q"', "s"), ("'open", "s")]
    java = "/* a // b\n\"c\" */ d('\\''); // e /* f\ng \"h /* i\" \"\"\"\nj\\\"\"\"k\"\"\" l /* m"
    assert told(java, "java") == [('/* a // b\n"c" */', "c"), ("'\\''", "s"), ("// e /* f", "c"), ('"h /* i"', "s"),
                                  ('"""\nj\\"""k"""', "s"), ("/* m", "c")]
    nested = "`a ${ f({x: `b ${1} c`}) + '}' } d` + {e: 1} // `"
    assert told(nested, "typescript") == [("`a ${", "s"), ("`b ${", "s"), ("} c`", "s"), ("'}'", "s"), ("} d`", "s"), ("// `", "c")]
    for language in ("python", "java", "typescript"):
        for odd in (None, "", "\\", "'", '"\\', "`\\", "`${", "/*", '"' * 3, "}}{", "'''\n"):
            assert all(0 <= a < b <= len(odd) for a, b, _ in spans(odd, language))
    assert spans("// x", "other") == []
    assert len(spans("`${" * 5000, "typescript")) == 5000


def test_review_keeps_rules_to_places(spark):
    files = files_df(spark, [("r", "A.java", "// eval(1)\nString s = \"eval(2)\";\neval(3); // eval(4)\nint n = 3600;"),
                             (None, "b.ts", "/*\neval(1) 100 */ eval(2)"), ("r", "c.py", "x = 'eval(1)'\r\neval(2)\r\n# eval(3)\n")])

    def found(**options):
        rows = review(files, security_rules=DEFAULT_RULES, persist=False, **options).findings
        return {(x.file, x.line) for x in rows.where("title in ('Use of eval', 'Magic Number')").collect()}
    assert found(rule_places=["code"]) == {("A.java", 3), ("c.py", 2)}
    assert found(rule_places=["comment", "string"], magic_lines=True) == {("A.java", 1), ("A.java", 2), ("A.java", 4), ("b.ts", 2), ("c.py", 1), ("c.py", 3)}


def test_texts_are_not_copied_to_every_task(spark):
    """However small a table seems to the planner, its texts meet their hits by a shuffle."""
    from revline.plans import catalog
    plan = catalog.QUERIES["rule_places"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 1  # the rules
