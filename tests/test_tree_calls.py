"""A folder tree with empty and undecodable files; loops that reach queries through calls."""

import os

from revline.operators import callgraph
from revline.operators.detectors import file_facts
from revline.operators.synthesis import progress_counts
from revline.sources.files import scan_tree

from conftest import files_df


def put(root, path, data=b""):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data)


def test_tree_keeps_every_file(spark, tmpdir_path):
    files = {"a.py": b"x = 1\r\n", "empty.py": b"", "p/b.py": b"y", "p/q/r/c.py": "é".encode(), "p/bad.py": b"\xff\xfe", "p/skip.txt": b"no", "z/__init__.py": b""}
    for path, data in files.items():
        put(tmpdir_path, path, data)
    os.symlink(os.path.join(tmpdir_path, "p"), os.path.join(tmpdir_path, "loop"))
    for depth in (1, 2, 4):
        rows = {r.path: (r.content, r.error) for r in scan_tree(spark, tmpdir_path, repo_id="r", depth=depth).collect()}
        assert rows == {"a.py": ("x = 1\n", None), "empty.py": ("", None), "p/b.py": ("y", None), "p/q/r/c.py": ("é", None),
                        "p/bad.py": (None, "invalid UTF-8"), "z/__init__.py": ("", None)}
    scanned = scan_tree(spark, tmpdir_path + "/", repo_id="r", errors="ignore", suffixes=(".py", ".txt"))
    assert {r.path: r.content for r in scanned.collect()}["p/bad.py"] == "" and scanned.count() == 7
    counts = progress_counts(scan_tree(spark, tmpdir_path, repo_id="r"), scan_tree(spark, tmpdir_path, repo_id="r")).first()
    assert counts.total_files == 6


def test_tree_lists_on_executors(spark, tmpdir_path):
    for i in range(2000):
        put(tmpdir_path, f"d{i % 20}/s{i % 7}/f{i}.py", b"" if i % 3 else b"x")
    df = scan_tree(spark, tmpdir_path, repo_id="r")
    assert df.rdd.getNumPartitions() == 21 and df.count() == 2000 and df.where("content = ''").count() == 1333


def test_loops_reach_queries_through_calls(spark):
    files = [("r", "a.py", "def top(db, rows):\n    for r in rows:\n        mid(db, r)\n        clean(r)\n        helper.far(db)\n"
                           "def mid(db, r):\n    return low(db, r)\ndef low(db, r):\n    db.execute(r)\ndef clean(r):\n    return r\n"),
             ("r", "b.py", "def far(db):\n    back(db)\ndef back(db):\n    far(db)\n    db.fetchall()\n"),
             ("r", "c.py", "for x in y:\n    far(x)\n    far2(x)\ndef clean(r):\n    db.query(r)\n"),
             ("s", "d.py", "def f(x):\n    while x:\n        f(x)\n        mid(x)\n"), (None, "e.py", "def g(d):\n    d.raw()\n[g(d) for d in e]\n"),
             ("r", "bad.py", "def f(:")]
    facts = file_facts(files_df(spark, files))
    got = sorted((r.repo_id or "", r.path, r.line, r.call, r.calls) for r in callgraph.loop_queries(facts).collect())
    # mid: two calls down; clean of a.py makes none, though c.py's does; far recurses; s has no query
    assert got == [("", "e.py", 3, "g", 1), ("r", "a.py", 3, "mid", 2), ("r", "a.py", 5, "helper.far", 2), ("r", "c.py", 2, "far", 2)]
    assert callgraph.loop_queries(file_facts(files_df(spark, files[:0]))).count() == 0
