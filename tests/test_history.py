"""Files, changes and merge bases on commit graphs, against a plain walk of small random graphs."""

import random

import pytest

from revline.operators import history


def graph(seed, n=60):
    """Commits with up to three parents, clock skew, an unknown parent and repeated rows."""
    rng = random.Random(seed)
    parents, rows = {}, []
    for i in range(n):
        name = f"c{i}"
        near = [f"c{j}" for j in range(max(0, i - 6), i)]
        parents[name] = rng.sample(near, min(len(near), rng.choice([1, 1, 1, 2, 3]))) if rng.random() > 0.04 else []
        seq = i + rng.choice([0, 0, 0, -9])
        rows += [("r", name, p, k, seq) for k, p in enumerate(parents[name])] or [("r", name, None if i % 2 else "gone", 0, seq)]
    rows += rows[:3] + [("r", None, "c1", 0, 1), (None, "c1", "c0", 0, 1)]
    versions = [("r", f"f{rng.randint(0, 5)}", f"c{i}", f"v{rng.randint(0, 9)}", rng.random() < 0.15) for i in range(n) if rng.random() < 0.7]
    return parents, rows, versions


def order_of(parents, rows):
    at = {}
    for _, c, _, _, seq in rows:
        if c in parents and _ is not None:
            at[c] = max(at.get(c, seq), seq)
    for c in parents:  # parents come first
        at[c] = max([at[c], *[at[p] + 1 for p in parents[c]]])
    return at


def reach(parents, c):
    seen, todo = set(), [c]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += parents[x]
    return seen


def tree(parents, at, versions, c):
    best = {}
    seen = reach(parents, c)
    for _, path, commit, content, gone in versions:
        if commit in seen:
            best[path] = max(best.get(path, ((-1, "", False, ""),)), ((at[commit], commit, gone, content),))
    return {p: (v[0][1], v[0][3]) for p, v in best.items() if not v[0][2]}


COMMITS = "repo_id string, commit string, parent string, parent_no int, seq long"
VERSIONS = "repo_id string, path string, commit string, content string, is_deleted boolean"


def test_graph_equals_a_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(history, "STRETCH", 4)
    parents, rows, versions = graph(2)
    h = history.History(spark.createDataFrame(rows, COMMITS).repartition(3), "seq")
    at = order_of(parents, rows)
    wanted = ["c59", "c41", "c7", "c0"]
    vs = spark.createDataFrame(versions, VERSIONS)
    got = {}
    for r in h.files_at(vs, spark.createDataFrame([("r", c) for c in wanted] + [("r", "none")], "repo_id string, at string")).collect():
        got.setdefault(r["at"], {})[r.path] = (r.commit, r.content)
    assert got == {c: t for c in wanted if (t := tree(parents, at, versions, c))}
    pairs = [("c30", "c59"), ("c59", "c58"), ("c12", "c33"), ("c5", "c5")]
    pf = spark.createDataFrame([("r", *p) for p in pairs], "repo_id string, a string, b string")
    base = {}
    for a, b in pairs:
        both = reach(parents, a) & reach(parents, b)
        base[a, b] = max(both, key=lambda c: (at[c], c)) if both else None
    assert {(r.a, r.b): r.base for r in h.merge_bases(pf).collect()} == base
    for since in (False, True):
        want = set()
        for a, b in pairs:
            old = base[a, b] if since else a
            x = {p: v[1] for p, v in tree(parents, at, versions, old).items()} if old else {}
            y = {p: v[1] for p, v in tree(parents, at, versions, b).items()}
            want |= {(a, b, p, "added" if p not in x else "deleted" if p not in y else "modified") for p in x.keys() | y.keys() if x.get(p) != y.get(p)}
        assert {tuple(r)[1:] for r in h.changed_files(vs, pf, since).collect()} == want


def test_rounds_grow_with_the_digits_of_the_depth(spark, monkeypatch):
    rounds = []
    write = history.materialize
    monkeypatch.setattr(history, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    rows = [("r", f"c{i}", f"c{i - 1}" if i else None, 0, i) for i in range(300)]
    on = history.lines(spark.createDataFrame(rows, COMMITS))
    assert on.select("line").distinct().count() == 1 and on.agg({"pos": "max"}).first()[0] == 299 and len(rounds) <= 11
    rounds.clear()
    at = history.ancestors(spark.createDataFrame(rows, COMMITS), spark.createDataFrame([("r", "c299")], "repo_id string, at string"), on)
    assert at.first().pos == 299 and len(rounds) <= 4


def test_odd_graphs(spark):
    none = history.History(spark.createDataFrame([], COMMITS), "seq")
    wanted = spark.createDataFrame([("r", "c1")], "repo_id string, at string")
    assert none.files_at(spark.createDataFrame([], VERSIONS), wanted).count() == 0
    loop = spark.createDataFrame([("r", "a", "b", 0, 1), ("r", "b", "a", 0, 2)], COMMITS)
    with pytest.raises(ValueError, match="cycle"):
        history.lines(loop)
    side = spark.createDataFrame([("r", "a", None, 0, 5), ("r", "b", "a", 0, 2), ("r", "b", "c", 1, 2), ("r", "c", "b", 0, 1)], COMMITS)
    with pytest.raises(ValueError, match="cycle"):
        history.ordered(side, "seq")


def test_a_long_line_is_resolved_inside_batches(spark, monkeypatch):
    """Rounds of joins run over a commit for each batch; commits in no order have the same lines."""
    from revline.operators import history
    rounds = []
    write = history.materialize
    monkeypatch.setattr(history, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    n = 3000
    name = lambda i: f"c{i * 7919 % 10007}"
    rows = [("r", name(i), name(i - 1) if i else None, 0, i) for i in range(n)]
    commits = spark.createDataFrame(rows, "repo_id string, commit string, parent string, parent_no int, seq long")
    want = {name(i): (name(0), i) for i in range(n)}
    assert {r.commit: (r.line, r.pos) for r in history.lines(commits, "seq").collect()} == want
    assert rounds.count("lines") <= 6  # 12 binary digits
    assert {r.commit: (r.line, r.pos) for r in history.lines(commits).collect()} == want
