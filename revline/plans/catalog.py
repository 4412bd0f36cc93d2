"""Registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revline.operators import detectors as D
from revline.operators import synthesis as S
from revline.sources import gen
from revline.sources.tables import load, load_balanced, parts, spread_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _gen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # spread the narrow part rows before generating wide content (see tables.balanced)
    return gen.gen_source_files(load_balanced(spark, sf_dir, "part", "p_partkey"))


def _gen_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select((F.col("p_partkey") % 50).cast("string").alias("repo_id")).distinct()


@query("repo_scores")
def repo_scores(spark, sf_dir):
    """Flagship: generated files → parse once → all detectors → per-repo score and grades."""
    findings = D.review_findings(_gen_files(spark, sf_dir))
    return S.repo_scores(findings, repos=_gen_repos(spark, sf_dir))


# ---- C: facts ---------------------------------------------------------------------------------
from revline.functions.text import line_count, normalize_newlines  # noqa: E402
from revline.operators import advisories as AD  # noqa: E402
from revline.operators import facts as C  # noqa: E402
from revline.operators import rules as R  # noqa: E402
from revline.operators import scope as B  # noqa: E402
from revline.sources import config as CFG  # noqa: E402
from revline.sources import reports as REP  # noqa: E402


def _facts(spark, sf_dir):
    return D.file_facts(_gen_files(spark, sf_dir))


@query("line_counts")
def line_counts(spark, sf_dir):
    """C4 over whole documents."""
    docs = load_balanced(spark, sf_dir, "documents", "doc_id")
    return docs.select("doc_id", line_count(normalize_newlines("text")).alias("total_lines"))


@query("function_facts")
def function_facts(spark, sf_dir):
    fns = C.explode_functions(_facts(spark, sf_dir))
    return fns.select("repo_id", "path", "name", "line", "end_line", F.size("args").alias("n_args"),
                      F.array_join("args", ",").alias("args_list"), "complexity")


@query("class_facts")
def class_facts(spark, sf_dir):
    cls = C.explode_classes(_facts(spark, sf_dir))
    return cls.select("repo_id", "path", "name", "line", "end_line", F.size("methods").alias("n_methods"))


@query("import_facts")
def import_facts(spark, sf_dir):
    return C.explode_imports(_facts(spark, sf_dir))


@query("call_facts")
def call_facts(spark, sf_dir):
    return C.explode_calls(_facts(spark, sf_dir))


@query("parse_errors")
def parse_errors(spark, sf_dir):
    return C.parse_errors(_facts(spark, sf_dir))


@query("syntax_check")
def syntax_check(spark, sf_dir):
    """C6 as an Arrow pandas_udf over every generated file."""
    files = _gen_files(spark, sf_dir)
    ok = C.syntax_ok_udf()
    return files.select("repo_id", "path", ok(normalize_newlines("content")).alias("valid"))


# ---- D: detectors -----------------------------------------------------------------------------
FINDING_OUT = ["id", "repo_id", "file", "line", "severity", "category", "title", "description", "auto_fixable"]


@query("smell_findings")
def smell_findings(spark, sf_dir):
    return D.review_findings(_gen_files(spark, sf_dir), D.SMELL_DETECTORS).select(*FINDING_OUT)


@query("complexity_findings")
def complexity_findings(spark, sf_dir):
    return D.review_findings(_gen_files(spark, sf_dir), ["complexity"]).select(*FINDING_OUT)


@query("script_findings")
def script_findings(spark, sf_dir):
    """Native substring rules, no parse."""
    return D.review_findings(_gen_files(spark, sf_dir), ["unsafe_call", "missing_docstring"]).select(*FINDING_OUT)


@query("all_findings")
def all_findings(spark, sf_dir):
    """E1 + E12: every detector in one parse, deduplicated on the content-hash id."""
    f = S.dedup_findings(D.review_findings(_gen_files(spark, sf_dir)))
    return f.select(*FINDING_OUT, "stage", "stage_order")


# ---- A/D12: tool reports ------------------------------------------------------------------------
@query("lint_findings")
def lint_findings(spark, sf_dir):
    issues = REP.ingest_lint(gen.gen_lint_reports(load(spark, sf_dir, "part")))
    return REP.lint_findings(issues).select("id", "repo_id", "file", "line", "severity", "title", "description")


@query("lint_errors")
def lint_errors(spark, sf_dir):
    return REP.lint_errors(REP.ingest_lint(gen.gen_lint_reports(load(spark, sf_dir, "part"))))


@query("complexity_report")
def complexity_report(spark, sf_dir):
    return REP.ingest_complexity(gen.gen_complexity_reports(load(spark, sf_dir, "part")))


@query("complexity_report_findings")
def complexity_report_findings(spark, sf_dir):
    blocks = REP.ingest_complexity(gen.gen_complexity_reports(load(spark, sf_dir, "part")))
    return REP.complexity_report_findings(blocks).select("id", "repo_id", "file", "line", "title", "description")


# ---- D8/D9/D11/D16: rules -------------------------------------------------------------------------
def _secret_docs(spark, sf_dir):
    return gen.gen_secret_text(load_balanced(spark, sf_dir, "documents", "doc_id"))


@query("secret_mask")
def secret_mask(spark, sf_dir):
    return R.masked(_secret_docs(spark, sf_dir))


@query("secret_findings")
def secret_findings(spark, sf_dir):
    return R.secret_counts(_secret_docs(spark, sf_dir))


@query("rule_findings")
def rule_findings(spark, sf_dir):
    return R.scan_rules(_secret_docs(spark, sf_dir))


@query("advisory_hits")
def advisory_hits(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return AD.hits(gen.gen_requirements(part), gen.gen_advisories(part))


@query("policy_violations")
def policy_violations(spark, sf_dir):
    return R.policy_violations(load_balanced(spark, sf_dir, "documents", "doc_id"))


# ---- B / A6: scope and config -------------------------------------------------------------------
def _scoped_paths(spark, sf_dir):
    paths = gen.gen_scope_paths(load(spark, sf_dir, "part"))
    return B.exclude_globs(B.exclude_dirs(B.python_files(paths), B.FULL_PHASE_EXCLUDES))


@query("scope_files")
def scope_files(spark, sf_dir):
    return _scoped_paths(spark, sf_dir)


@query("file_cap")
def file_cap(spark, sf_dir):
    """B7 + E19: the first 10 files per repo by path, with total_files counted before the cap."""
    scoped = _scoped_paths(spark, sf_dir)
    capped = B.cap_files(scoped, 10)
    counts = S.progress_counts(scoped, capped)
    return capped.join(counts, "repo_id").select("repo_id", "path", "total_files", "files_analyzed")


def _configs(spark, sf_dir, variant="root"):
    return CFG.effective_config(gen.gen_repo_configs(load(spark, sf_dir, "customer")), variant)


@query("config_effective")
def config_effective(spark, sf_dir):
    c = _configs(spark, sf_dir)
    return c.select("repo_id", "severity_threshold", F.array_join("enabled_checks", ",").alias("enabled_checks"),
                    F.col("auto_fix.enabled").alias("auto_fix_enabled"),
                    F.col("auto_fix.safe_only").alias("auto_fix_safe_only"), "max_analysis_time",
                    F.array_join("skip_categories", ",").alias("skip_categories"))


def _order_findings(spark, sf_dir):
    return gen.gen_findings_orders(load_balanced(spark, sf_dir, "orders", "o_orderkey"))


@query("threshold_filter")
def threshold_filter(spark, sf_dir):
    """B8 + B9 with each repo's effective config."""
    kept = B.apply_config(_order_findings(spark, sf_dir), _configs(spark, sf_dir))
    return kept.select("id", "repo_id", "severity", "stage")


# ---- E: synthesis ------------------------------------------------------------------------------
import datetime as _dt  # noqa: E402

from revline.operators import fixes as X  # noqa: E402
from revline.operators import languages as L  # noqa: E402
from revline.operators import metrics as M  # noqa: E402
from revline.operators import policy as P  # noqa: E402
from revline.operators import prompts as PR  # noqa: E402
from revline.operators import versions as V  # noqa: E402
from revline.plans import reports as RP  # noqa: E402
from revline.streaming import fold as G  # noqa: E402
from revline.streaming import incremental as GI  # noqa: E402


def _event_findings(spark, sf_dir):
    return gen.gen_findings_events(load_balanced(spark, sf_dir, "events", "event_id"))


def _customer_repos(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("repo_id"))


@query("prioritized")
def prioritized(spark, sf_dir):
    """E5: position in each repo's list by severity rank (stable: stage, insertion order, id)."""
    return S.prioritize(_order_findings(spark, sf_dir)).select("id", "repo_id", "severity", "priority")


@query("prioritized_alpha")
def prioritized_alpha(spark, sf_dir):
    """The same list sorted by the severity string."""
    return S.prioritize(_order_findings(spark, sf_dir), "alpha").select("id", "repo_id", "severity", "priority")


@query("event_scores")
def event_scores(spark, sf_dir):
    """E2–E4, E11 over findings from events (repo = user and hour)."""
    return S.repo_scores(_event_findings(spark, sf_dir))


@query("order_scores")
def order_scores(spark, sf_dir):
    """E2 with every customer-repo listed (left join), findings from orders."""
    return S.repo_scores(_order_findings(spark, sf_dir), repos=_customer_repos(spark, sf_dir))


@query("severity_counts")
def severity_counts(spark, sf_dir):
    return S.severity_counts(_event_findings(spark, sf_dir))


@query("total_issues")
def total_issues(spark, sf_dir):
    return S.total_issues(_event_findings(spark, sf_dir))


@query("category_heat")
def category_heat(spark, sf_dir):
    return S.category_heat(_event_findings(spark, sf_dir))


@query("stage_counts")
def stage_counts(spark, sf_dir):
    return S.stage_counts(_event_findings(spark, sf_dir))


@query("top5_per_repo")
def top5_per_repo(spark, sf_dir):
    return S.top_k(_order_findings(spark, sf_dir), 5)


@query("quick_wins")
def quick_wins(spark, sf_dir):
    return S.quick_wins(_order_findings(spark, sf_dir), 3)


# ---- fixes ---------------------------------------------------------------------------------------
def _candidates(spark, sf_dir):
    return X.fix_candidates(_order_findings(spark, sf_dir))


@query("fix_gate")
def fix_gate(spark, sf_dir):
    return X.fix_gate(_order_findings(spark, sf_dir), _configs(spark, sf_dir))


@query("fixes")
def fixes(spark, sf_dir):
    return X.valid_fixes(_candidates(spark, sf_dir))


@query("fix_errors")
def fix_errors(spark, sf_dir):
    return X.fix_errors(_candidates(spark, sf_dir))


@query("approved_fixes")
def approved_fixes(spark, sf_dir):
    """Approvals are the findings of orders above 250,000."""
    orders = load(spark, sf_dir, "orders")
    approvals = gen.gen_findings_orders(orders.filter(F.col("o_totalprice") > 250000)).select(F.col("id").alias("issue_id"))
    return X.approved(X.valid_fixes(_candidates(spark, sf_dir)), approvals).select("repo_id", "issue_id", "status")


@query("safe_fixes")
def safe_fixes(spark, sf_dir):
    return X.safe_only(_candidates(spark, sf_dir), _configs(spark, sf_dir)) \
        .select("issue_id", "repo_id", "severity", "valid")


@query("test_stubs")
def test_stubs(spark, sf_dir):
    return X.test_stubs(D.review_findings(_gen_files(spark, sf_dir), D.SMELL_DETECTORS))


@query("issue_payloads")
def issue_payloads(spark, sf_dir):
    p = X.issue_payloads(D.review_findings(_gen_files(spark, sf_dir), D.SMELL_DETECTORS))
    return p.select("id", "repo_id", "title", "body", F.array_join("labels", ",").alias("labels"))


# ---- B5/B6: versions -------------------------------------------------------------------------------
DIFF_FROM = (_dt.date(1997, 1, 1) - _dt.date(1970, 1, 1)).days
DIFF_TO = (_dt.date(1999, 1, 1) - _dt.date(1970, 1, 1)).days


def _versions(spark, sf_dir):
    return gen.gen_file_versions(load_balanced(spark, sf_dir, "orders", "o_orderkey"))


@query("file_as_of")
def file_as_of(spark, sf_dir):
    return V.snapshot(_versions(spark, sf_dir), DIFF_TO)


@query("changed_files")
def changed_files(spark, sf_dir):
    return V.changed_files(_versions(spark, sf_dir), DIFF_FROM, DIFF_TO)


# ---- D14/D15/A5: policy ------------------------------------------------------------------------------
def _policy_top(spark, sf_dir):
    # a text meets nearly every policy: parts by the size of the table, so that the pairs of one task do not grow with it
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return P.topk_policies(docs.repartition(parts(docs), "doc_id"), load(spark, sf_dir, "benchmark"), k=3)


@query("policy_topk")
def policy_topk(spark, sf_dir):
    return _policy_top(spark, sf_dir)


def _policy_findings(spark, sf_dir):
    files = gen.doc_files(load(spark, sf_dir, "documents")).withColumnRenamed("path", "file")
    return P.policy_findings(files, _policy_top(spark, sf_dir))


@query("policy_findings")
def policy_findings(spark, sf_dir):
    return _policy_findings(spark, sf_dir)


@query("policy_index")
def policy_index(spark, sf_dir):
    return P.index_message(load(spark, sf_dir, "benchmark"))


@query("policy_run_check")
def policy_run_check(spark, sf_dir):
    """Policy findings counted, the first one shown."""
    return G.run_check(_policy_findings(spark, sf_dir))


@query("embedding_topk")
def embedding_topk(spark, sf_dir):
    """D15 (b): the 3 nearest label centroids of every embedding by cosine similarity."""
    emb = load(spark, sf_dir, "embeddings")
    top = P.cosine_topk(emb, P.centroids(emb), k=3)
    return top.select("vec_id", "rank", "label", F.round("similarity", 4).alias("similarity"))


# ---- D17/D18: prompts ------------------------------------------------------------------------------------
@query("persona_prompts")
def persona_prompts(spark, sf_dir):
    files = gen.doc_files(load(spark, sf_dir, "documents"))
    return PR.review_prompts(files, "persona_id").select("doc_id", "persona_id", "system_prompt", "human_prompt")


@query("logic_findings")
def logic_findings(spark, sf_dir):
    """Prompts are user turns; the model's response is the next assistant turn of the conversation."""
    conv = load(spark, sf_dir, "conversations")
    prompts = conv.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"),
                                    F.col("turn").cast("string")).alias("path"), F.col("text").alias("content"))
    responses = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return PR.responses_to_findings(PR.review_prompts(prompts), responses, ["conv_id", "turn"])


# ---- D19–D21: metrics ------------------------------------------------------------------------------------
@query("test_summary")
def test_summary(spark, sf_dir):
    return M.test_summary(gen.gen_test_results(load(spark, sf_dir, "events")))


@query("coverage")
def coverage(spark, sf_dir):
    return M.coverage(gen.gen_line_hits(load_balanced(spark, sf_dir, "lineitem", "l_orderkey")))


@query("latency_profile")
def latency_profile(spark, sf_dir):
    return M.latency_profile(gen.gen_runs(load(spark, sf_dir, "events")))


@query("latency_quantiles")
def latency_quantiles(spark, sf_dir):
    return M.latency_quantiles(gen.gen_runs(load(spark, sf_dir, "events")))


# ---- F: reports ------------------------------------------------------------------------------------------
RUN_DATE = "2024-01-31T00:00:00"


@query("markdown_report")
def markdown_report(spark, sf_dir):
    return RP.markdown_lines(_order_findings(spark, sf_dir), _customer_repos(spark, sf_dir))


@query("json_report")
def json_report(spark, sf_dir):
    return RP.json_lines(_order_findings(spark, sf_dir), _customer_repos(spark, sf_dir))


@query("bootstrap_report")
def bootstrap_report(spark, sf_dir):
    f = D.review_findings(_gen_files(spark, sf_dir), ["unsafe_call", "missing_docstring"])
    return RP.bootstrap_lines(f)


@query("full_phase_report")
def full_phase_report(spark, sf_dir):
    return RP.full_phase_lines(_order_findings(spark, sf_dir), RUN_DATE)


# ---- G: streaming ------------------------------------------------------------------------------------------
@query("run_progress")
def run_progress(spark, sf_dir):
    """G1–G3 in batch: last step per run, accumulated counters, step label."""
    return G.step_labels(G.fold_runs(gen.gen_review_events(load(spark, sf_dir, "events"))))


@query("stream_progress")
def stream_progress(spark, sf_dir):
    """G1–G3 with Structured Streaming over the events file (update mode)."""
    schema = load(spark, sf_dir, "events").schema
    stream = GI.stream_file_table(spark, sf_dir, schema, "events.parquet")
    folded = G.fold_runs(gen.gen_review_events(stream))
    return G.step_labels(GI.run_to_table(spark, folded, "progress", keys=["run_id"]))


@query("stream_scores")
def stream_scores(spark, sf_dir):
    """Files arrive as a stream; parse and detectors per micro-batch, scores over the latest push of each file."""
    schema = load(spark, sf_dir, "part").schema
    files = gen.gen_source_files(spread_stream(GI.stream_file_table(spark, sf_dir, schema, "part.parquet"), "p_partkey"))
    return GI.run_reviews(spark, files, "scores")


# ---- B10/B11: languages ------------------------------------------------------------------------------------
@query("language_counts")
def language_counts(spark, sf_dir):
    return L.language_counts(gen.gen_scope_paths(load(spark, sf_dir, "part")))


@query("primary_language")
def primary_language(spark, sf_dir):
    return L.primary_language(gen.gen_scope_paths(load(spark, sf_dir, "part")))


# ---- the whole review -----------------------------------------------------------------------------------
from revline.plans.review import review as _review  # noqa: E402


@query("review_scores")
def review_scores(spark, sf_dir):
    """Files + lint reports + complexity reports through the whole review; per-repo scores."""
    part = load_balanced(spark, sf_dir, "part", "p_partkey")
    r = _review(gen.gen_source_files(part), repos=_gen_repos(spark, sf_dir),
                lint_reports=gen.gen_lint_reports(part), complexity_reports=gen.gen_complexity_reports(part))
    return r.scores


@query("node_counts")
def node_counts(spark, sf_dir):
    """AST node count per generated file (null for files that do not parse)."""
    return _facts(spark, sf_dir).select("repo_id", "path", "status", "node_count")


@query("diff_scope")
def diff_scope(spark, sf_dir):
    """B4 ``diff``: the files of the snapshot at the later commit that changed since the earlier one."""
    versions = _versions(spark, sf_dir)
    files = V.snapshot(versions, DIFF_TO).select("repo_id", "path", "content")
    return B.select_scope(files, "diff", changed=V.changed_files(versions, DIFF_FROM, DIFF_TO))


@query("n_plus_one")
def n_plus_one(spark, sf_dir):
    """Query calls inside loops, over data-access files generated from orders."""
    files = gen.gen_loop_files(load_balanced(spark, sf_dir, "orders", "o_orderkey"))
    return D.n_plus_one(D.file_facts(files)).select("id", "repo_id", "file", "line", "title", "description")


# ---- shapes of syntax that the other generated files lack, each text distinct ------------------------------
def _shape_files(spark, sf_dir):
    return gen.gen_shape_files(load_balanced(spark, sf_dir, "part", "p_partkey"))


def _shape_facts(spark, sf_dir):
    return D.file_facts(_shape_files(spark, sf_dir))


@query("decorator_facts")
def decorator_facts(spark, sf_dir):
    """Functions with their decorators, end lines and complexity."""
    fns = C.explode_functions(_shape_facts(spark, sf_dir))
    return fns.select("repo_id", "path", "name", "line", "end_line", F.array_join("decorators", "|").alias("decorator_list"), "complexity")


@query("method_facts")
def method_facts(spark, sf_dir):
    """Classes with the names of their methods (``async`` ones do not count)."""
    cls = C.explode_classes(_shape_facts(spark, sf_dir))
    return cls.select("repo_id", "path", "name", "line", "end_line", F.array_join("methods", ",").alias("method_list"))


@query("import_kinds")
def import_kinds(spark, sf_dir):
    """Aliased, from- and relative imports."""
    return C.explode_imports(_shape_facts(spark, sf_dir))


@query("error_kinds")
def error_kinds(spark, sf_dir):
    """An unclosed bracket, a missing block, an unclosed string."""
    return C.parse_errors(_shape_facts(spark, sf_dir))


@query("magic_numbers")
def magic_numbers(spark, sf_dir):
    """D4 over each of the numbers."""
    found = D.review_findings(_shape_files(spark, sf_dir), ["magic_number"])
    return found.select("id", "repo_id", "file", "line", "title", "description")


@query("frameworks")
def frameworks(spark, sf_dir):
    """Frameworks of each repository, from its imports."""
    found = L.frameworks(C.explode_imports(_shape_facts(spark, sf_dir)))
    return found.select("repo_id", F.array_join("frameworks", ",").alias("frameworks"))


@query("missing_files")
def missing_files(spark, sf_dir):
    """Paths that some version has and the snapshot at a commit has not."""
    versions = _versions(spark, sf_dir)
    return V.missing_files(versions, versions, DIFF_FROM)


@query("coverage_by_repo")
def coverage_by_repo(spark, sf_dir):
    """D20 per repository (here: supplier), over distinct lines of its files."""
    items = load_balanced(spark, sf_dir, "lineitem", "l_orderkey")
    hits = items.select(F.col("l_suppkey").cast("string").alias("repo_id"), F.col("l_orderkey").alias("file"),
                        (F.col("l_linenumber") % 3).alias("line"), (F.floor("l_quantity") % 3).alias("hits"))
    return M.coverage_by_repo(hits)


@query("run_state")
def run_state(spark, sf_dir):
    """G1 over any key: the last value each run (user) wrote to each key (event type)."""
    events = load(spark, sf_dir, "events")
    updates = events.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("key"),
                            F.when(F.col("event_id") % 5 > 0, F.col("event_id").cast("string")).alias("value"), "ts", "event_id")
    return G.fold_keys(updates)


# ---- B5/B6 on a commit graph ---------------------------------------------------------------------
from revline.operators.history import History  # noqa: E402


def _history(spark, sf_dir):
    orders = load_balanced(spark, sf_dir, "orders", "o_orderkey")
    return History(gen.gen_commits(orders), "seq"), gen.gen_commit_versions(orders), gen.gen_commit_pairs(orders)


@query("dag_file_as_of")
def dag_file_as_of(spark, sf_dir):
    """Every live file at two commits of each repository, through branches and merges."""
    history, versions, pairs = _history(spark, sf_dir)
    wanted = pairs.select("repo_id", F.explode(F.array("a", "b")).alias("at"))
    return history.files_at(versions, wanted)


@query("dag_changed_files")
def dag_changed_files(spark, sf_dir):
    """Files that differ between the two commits (``A..B``) and since their merge base (``A...B``)."""
    history, versions, pairs = _history(spark, sf_dir)
    two = history.changed_files(versions, pairs).withColumn("dots", F.lit(2))
    three = history.changed_files(versions, pairs, since_base=True).withColumn("dots", F.lit(3))
    return two.unionByName(three)


# ---- D15 with weights ------------------------------------------------------------------------------
from revline.operators import retrieval as RT  # noqa: E402


@query("policy_weighted_topk")
def policy_weighted_topk(spark, sf_dir):
    """The three policies that fit each document best, by weighted terms through a pruned inverted index."""
    index = RT.build_index(load(spark, sf_dir, "benchmark"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return RT.topk(docs, index, k=3, parts=parts(docs))


# ---- D8, D16 with rules in a table -------------------------------------------------------------------
from revline.operators import rule_tables as RB  # noqa: E402

# ours: two rules without a literal text, beside the default ones
PLAIN_RULES = [{"rule_id": "digits", "regex": "[0-9]{6}", "severity": "info", "cwe_id": "CWE-2", "title": "Long number"},
               {"rule_id": "shout", "regex": "^[A-Z ]{8,}$", "severity": "info", "cwe_id": "CWE-3", "title": "Line in capitals"}]


@query("rule_table_findings")
def rule_table_findings(spark, sf_dir):
    """The default rules, two without a literal and one for each benchmark item, all in a table, over every line."""
    rules = RB.rule_table(spark, R.DEFAULT_RULES + PLAIN_RULES).unionByName(gen.gen_passage_rules(load(spark, sf_dir, "benchmark")))
    return RB.scan_rule_table(_secret_docs(spark, sf_dir), rules)


@query("policy_table_violations")
def policy_table_violations(spark, sf_dir):
    """A text must hold a license line and no benchmark passage; the rules in a table."""
    barred = gen.gen_passage_rules(load(spark, sf_dir, "benchmark")).select(
        "rule_id", F.lit(None).cast("string").alias("must_match"), F.col("regex").alias("must_not_match"), "literal")
    own = spark.createDataFrame([("license-header", "(?m)^.*License.*$", None, "License"), ("digits", None, "[0-9]{6}", None)], barred.schema)
    return RB.violations(load_balanced(spark, sf_dir, "documents", "doc_id"), barred.unionByName(own))


# ---- D9 with ordinary version strings ------------------------------------------------------------------

@query("advisory_hits_mixed")
def advisory_hits_mixed(spark, sf_dir):
    """Version strings of many forms, a hot package, open and unreadable bounds."""
    part = load_balanced(spark, sf_dir, "part", "p_partkey")
    return AD.hits(gen.gen_mixed_requirements(part), gen.gen_mixed_advisories(part))


@query("advisory_errors")
def advisory_errors(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return AD.errors(gen.gen_mixed_requirements(part), gen.gen_mixed_advisories(part))


# ---- G4, E7 with state and event time ----------------------------------------------------------------------
from revline.session import scratch_path  # noqa: E402
from revline.streaming import live as GL  # noqa: E402


@query("stream_severity_counts")
def stream_severity_counts(spark, sf_dir):
    """E7 over three micro-batches of pushes: files emptied or rewritten take back their earlier findings."""
    folder = scratch_path(spark, f"pushes-{GI.uuid.uuid4().hex[:8]}")
    live = GL.LiveReview(spark, "severities")
    for push in gen.gen_pushes(load_balanced(spark, sf_dir, "part", "p_partkey")):
        push.write.mode("append").parquet(folder)  # as many files as tasks; the stream goes on with them as one micro-batch
        live.run(GI.stream_file_table(spark, folder, "repo_id string, path string, content string, version long"), "version")
    return live.severity_counts()


@query("stream_daily_counts")
def stream_daily_counts(spark, sf_dir):
    """Findings per repository, severity and day by event time: repeats dropped, days given out behind the watermark."""
    events = GI.stream_file_table(spark, sf_dir, load(spark, sf_dir, "events").schema, "events.parquet")
    return GL.run_append(spark, GL.daily_counts(gen.gen_event_stream(events), "1 day"), "daily")


# ---- D10 through calls ---------------------------------------------------------------------------------------
from revline.operators import callgraph as CG  # noqa: E402


@query("n_plus_one_calls")
def n_plus_one_calls(spark, sf_dir):
    """Loops that reach a query through calls, across files of a repository and through recursion."""
    return CG.loop_queries(D.file_facts(gen.gen_call_files(load_balanced(spark, sf_dir, "part", "p_partkey"))))


# ---- B10: where rules match ------------------------------------------------------------------------------------
from revline.operators import lexer as LX  # noqa: E402


@query("rule_places")
def rule_places(spark, sf_dir):
    """Matches of eval in Python, Java and TypeScript files, told as code, comment or string."""
    files = gen.gen_place_files(load_balanced(spark, sf_dir, "part", "p_partkey"))
    keyed = files.withColumn("_key", F.struct("repo_id", "path"))
    hits = R.scan_rules(keyed, [r for r in R.DEFAULT_RULES if r["rule_id"] == "eval-call"], key="_key", text="content")
    return LX.placed(hits.select("_key.repo_id", "_key.path", "line_no", "rule_id"), files, RB.rule_table(spark, R.DEFAULT_RULES))


# ---- A6: YAML files in a table -----------------------------------------------------------------------------------
@query("config_from_yaml")
def config_from_yaml(spark, sf_dir):
    """Each repository's YAML file over the defaults; one that cannot be read has the defaults and an error."""
    read = CFG.configs_from_yaml(gen.gen_yaml_configs(load_balanced(spark, sf_dir, "customer", "c_custkey")))
    c = CFG.effective_config(read).join(read.select("repo_id", F.col("error").isNotNull().alias("failed")), "repo_id")
    return c.select("repo_id", "failed", "severity_threshold", F.array_join("enabled_checks", ",").alias("enabled_checks"),
                    F.col("auto_fix.enabled").alias("auto_fix_enabled"), F.col("auto_fix.safe_only").alias("auto_fix_safe_only"))
