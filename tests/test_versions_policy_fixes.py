"""B5, B6, D14, D15, D17, D18, E14–E21."""

import math

import numpy as np

from revline.operators import fixes as X
from revline.operators import policy as P
from revline.operators import prompts as PR
from revline.operators import versions as V

from conftest import findings_df


def _versions(spark):
    rows = [("r", "a.py", 1, 1, "a1", False), ("r", "a.py", 3, 2, "a3", False), ("r", "b.py", 2, 3, "b2", False),
            ("r", "b.py", 4, 4, None, True), ("r", "c.py", 4, 5, "c4", False), ("r", "d.py", 1, 6, "d1", False)]
    return spark.createDataFrame(rows, "repo_id string, path string, commit_seq int, version_id long, "
                                       "content string, is_deleted boolean")


def test_snapshot_and_diff(spark):
    v = _versions(spark)
    snap = {r["path"]: r["content"] for r in V.snapshot(v, 2).collect()}
    assert snap == {"a.py": "a1", "b.py": "b2", "d.py": "d1"}
    diff = {r["path"]: r["change_type"] for r in V.changed_files(v, 2, 4).collect()}
    assert diff == {"a.py": "modified", "b.py": "deleted", "c.py": "added"}


def test_policy_topk_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta"), (3, "nothing here")], "doc_id long, text string")
    pols = spark.createDataFrame([(10, "alpha beta"), (11, "gamma the"), (12, "delta the"), (13, "the")] +
                                 [(20 + i, "filler the") for i in range(16)], "item_id long, text string")
    top = P.topk_policies(docs, pols, k=2, max_df=0.1).collect()
    got = sorted((r["doc_id"], r["rank"], r["item_id"], r["score"]) for r in top)
    assert got == [(1, 1, 10, 2), (1, 2, 11, 1), (2, 1, 12, 1)]  # 'the'/'filler' are too common
    files = docs.selectExpr("doc_id", "concat('d', doc_id) as file")
    pf = {r["doc_id"]: r["description"] for r in P.policy_findings(files, P.topk_policies(docs, pols, k=2)).collect()}
    assert pf[1] == "Verified against standard: policy 10" and pf[3] == "Verified against standard: no matching policy"
    assert P.index_message(pols).collect()[0]["message"] == "Indexed 20 policy documents."


def test_cosine_topk_matches_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    q = rng.normal(size=(40, 8))
    c = rng.normal(size=(37, 8))
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "vec_id long, embedding array<double>")
    cdf = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(c)], "label long, centroid array<double>")
    got = P.cosine_topk(qdf, cdf, k=3, block_size=5).collect()
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    want = {(i, r + 1, int(j)) for i in range(40) for r, j in enumerate(np.argsort(-sims[i])[:3])}
    assert {(r["vec_id"], r["rank"], r["label"]) for r in got} == want
    assert all(math.isclose(r["similarity"], sims[r["vec_id"], r["label"]], abs_tol=1e-9) for r in got)


def test_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 4.0], 0), (3, [5.0, 5.0], 1)],
                               "vec_id long, embedding array<double>, label int")
    got = {r["label"]: r["centroid"] for r in P.centroids(df).collect()}
    assert got == {0: [2.0, 3.0], 1: [5.0, 5.0]}


def test_prompts_and_persona_fallback(spark):
    files = spark.createDataFrame([("a.py", "x = 1", "mentor"), ("b.py", "y", "nobody"), ("c.py", "z", None)],
                                  "path string, content string, persona_id string")
    rows = {r["path"]: r for r in PR.review_prompts(files, "persona_id").collect()}
    assert rows["a.py"]["system_prompt"].startswith(PR.PERSONA_PROMPTS["mentor"] + "\nAnalyze the following code")
    assert rows["b.py"]["system_prompt"].startswith(PR.PERSONA_PROMPTS["architect"])
    assert rows["c.py"]["system_prompt"].startswith(PR.PERSONA_PROMPTS["architect"])
    assert rows["a.py"]["human_prompt"] == "File: a.py\n\nCode:\nx = 1"
    root = PR.review_prompts(files, variant="root", max_code_chars=2).collect()
    assert all(r["system_prompt"].endswith("Respond briefly.") for r in root)
    resp = spark.createDataFrame([("a.py", "r" * 300)], "path string, response string")
    f = PR.responses_to_findings(PR.review_prompts(files), resp, ["path"], path="path").collect()
    assert len(f) == 1 and f[0]["description"] == "r" * 200 + "..." and f[0]["recommendation"] == "r" * 300


def _f(repo, sev, fix, title, seq):
    return {"repo_id": repo, "file": "src/pkg/m.py", "line": 1, "severity": sev, "category": "pattern",
            "title": title, "description": "desc", "auto_fixable": fix, "stage": "pattern", "stage_order": 1, "seq": seq}


def test_fix_gate_and_candidates(spark):
    f = findings_df(spark, [_f("a", "high", True, "Long Function", 1), _f("a", "low", True, "bad\n)", 2),
                            _f("b", "medium", True, "x", 1), _f("c", "critical", False, "y", 1)])
    cfg = spark.createDataFrame([("a", (True, True)), ("b", (True, None)), ("c", (False, None)), ("d", (True, None))],
                                "repo_id string, auto_fix struct<enabled:boolean,safe_only:boolean>")
    gate = {r["repo_id"]: (r["decision_root"], r["decision_src"]) for r in X.fix_gate(f, cfg).collect()}
    assert gate == {"a": ("generate_fixes", "generate_fixes"), "b": ("skip_fixes", "generate_fixes"),
                    "c": ("skip_fixes", "skip_fixes"), "d": ("skip_fixes", "generate_fixes")}
    cand = X.fix_candidates(f)
    ok = X.valid_fixes(cand).collect()
    bad = X.fix_errors(cand).collect()
    assert sorted(r["fix_code"].split("\n")[0] for r in ok) == ["# Fixed Long Function", "# Fixed x"]
    assert len(bad) == 1 and bad[0]["error"].startswith("LLM generated invalid syntax for issue ")
    safe = {r["repo_id"]: r["severity"] for r in X.safe_only(cand, cfg).collect()}
    assert safe == {"a": "low", "b": "medium"}
    appr = spark.createDataFrame([(ok[0]["issue_id"],)], "issue_id string")
    assert X.approved(X.valid_fixes(cand), appr).count() == 1


def test_test_stub_and_payload(spark):
    f = findings_df(spark, [_f("a", "high", True, "T", 1)])
    stub = X.test_stubs(f).collect()[0]["test_code"]
    assert "from src.pkg.m import ..." in stub and "# Automatically generated to test: desc" in stub
    p = X.issue_payloads(f).collect()[0]
    assert p["labels"] == ["high", "pattern"] and p["body"] == "desc"
