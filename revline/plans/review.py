"""The whole review as one Spark plan: files (and tool reports) in, answers out.

    files ─ scope (B) ─ prepare + parse once (C) ─ detectors (D) ┐
    lint reports (A3/D12) ──────────────────────────────────────┤
    complexity reports (A4/D5) ─────────────────────────────────┼─ union (E1) ─ dedup (E12)
    model responses (D17) / policies (D14, D15) ────────────────┘        │
                                        per-repo config (A6, B8, B9) ────┤
                                                                         ▼
         scores, grades (E2–E4, E11) · prioritised (E5/E6) · counts (E7–E9) · top 5 (E10)
         quick wins (E13) · fixes (E14–E17) · reports (F1, F2) · errors · progress (E19)

Every output is a lazy DataFrame. Findings are read by all of them, so by default they are
written once to the shared checkpoint folder (``materialize``) and read back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revline.operators import advisories as AD
from revline.operators import detectors as D
from revline.operators import fixes as X
from revline.operators import languages as L
from revline.operators import policy as P
from revline.operators import prompts as PR
from revline.operators import rules as R
from revline.operators import scope as B
from revline.operators import synthesis as S
from revline.operators.facts import parse_errors
from revline.plans import reports as RP
from revline.registry import run_analyzers
from revline.session import materialize
from revline.sources import reports as REP


@dataclass
class Review:
    findings: DataFrame
    scores: DataFrame
    prioritized: DataFrame
    severity_counts: DataFrame
    category_heat: DataFrame
    top5: DataFrame
    quick_wins: DataFrame
    fix_candidates: DataFrame
    markdown: DataFrame
    json: DataFrame
    fixes: DataFrame
    prompts: DataFrame
    errors: DataFrame
    progress: DataFrame


def review(files: DataFrame, *, repos: DataFrame | None = None, config: DataFrame | None = None,
           scope: str = "full", target_files=None, changed: DataFrame | None = None, branch: str | None = None,
           exclude_dirs=None, exclude_globs=None, max_files: int | None = None,
           lint_reports: DataFrame | None = None, complexity_reports: DataFrame | None = None,
           responses: DataFrame | None = None, policies: DataFrame | None = None,
           security_rules=None, policy_rules=None, requirements: DataFrame | None = None,
           advisories: DataFrame | None = None, approvals: DataFrame | None = None,
           rule_places=None, magic_lines: bool = False, analyzers: list[str] | None = None, detectors=None,
           persist: bool = True) -> Review:
    """Review ``files(repo_id, path, content)``.

    ``config``: effective per-repo config (``sources.config.effective_config``) — applies the
    exclude patterns, severity threshold, enabled checks and skipped categories, chooses the persona of
    the prompts, and gates fixes (``safe_only`` included). ``responses``: ``(repo_id, path, response)``
    from the model for the logic stage. ``policies``: ``(item_id, text)`` for policy retrieval (one policy
    finding per file). Nothing is excluded unless ``exclude_dirs``, ``exclude_globs`` or ``config`` say so.

    ``security_rules`` and ``policy_rules`` (lists as in ``operators.rules``, or tables as in
    ``operators.rule_tables``) scan the lines and texts of files in every known language; ``requirements(repo_id, path, name, version)`` with ``advisories`` adds vulnerable dependencies.
    ``rule_places`` (of code, comment, string) keeps security matches that start there; ``magic_lines`` looks for magic
    numbers in the lines of known languages other than Python.
    Registered analyzers (the named ones, all if None) run over files of their extensions, Python or not.
    ``approvals(issue_id)`` keeps only approved fixes. Fixes that do not parse are rows of ``errors``.
    """
    every = B.select_scope(files, scope, target_files, changed, branch)
    every = B.exclude_globs(B.exclude_dirs(every, exclude_dirs or []), exclude_globs or [])
    if config is not None:
        every = B.exclude_configured(every, config)
    scoped = B.python_files(every)
    capped = B.cap_files(scoped, max_files)
    lined = B.cap_files(L.known_files(every), max_files)  # rules read lines of any known language

    def in_scope(reports: DataFrame) -> DataFrame:
        """Tool reports of the files under review only."""
        keys = [k for k in ("repo_id", "path") if k in reports.columns]
        return reports if scope == "full" and max_files is None else reports.join(capped.select(*keys).distinct(), keys, "left_semi")

    detectors = list(detectors or D.ALL_DETECTORS)
    facts = D.file_facts(capped)
    if persist:
        facts = materialize(facts, "file-facts")
    stages = [D.detect(facts, detectors)]
    errors = [parse_errors(facts).select("repo_id", "path", "error")]

    if lint_reports is not None:
        issues = REP.ingest_lint(in_scope(lint_reports))
        stages.append(REP.lint_findings(issues))
        errors.append(REP.lint_errors(issues).select("repo_id", "path", "error"))
    if complexity_reports is not None:
        blocks = REP.ingest_complexity(in_scope(complexity_reports))
        stages.append(REP.complexity_report_findings(blocks))
        errors.append(blocks.filter(F.col("error").isNotNull()).select("repo_id", "path", "error"))
    if security_rules is not None:
        stages.append(R.rule_findings(lined, security_rules, rule_places))
    if requirements is not None and advisories is not None:
        stages.append(R.advisory_findings(requirements, advisories))
        errors.append(AD.errors(requirements, advisories).select("repo_id", F.col("item").alias("path"), "error"))
    if magic_lines:
        stages.append(D.magic_lines(lined))
    if policy_rules is not None:
        stages.append(R.policy_rule_findings(lined, policy_rules))
    if (own := run_analyzers(every, analyzers)) is not None:
        stages.append(own)
    prompts = PR.review_prompts(capped)
    if config is not None:
        persona = config.select("repo_id", F.col("persona").alias("_persona"))
        prompts = PR.review_prompts(capped.join(persona, "repo_id", "left"), "_persona").drop("_persona")
    if responses is not None:
        logic = PR.responses_to_findings(prompts, responses, ["repo_id", "path"])
        stages.append(D.complete_findings(logic.withColumn("stage", F.lit("logic"))
                                          .withColumn("stage_order", F.lit(5)).withColumn("seq", F.lit(1).cast("long"))))
    if policies is not None:
        keyed = capped.select("repo_id", "path", "content").withColumn("doc_id", F.concat_ws("\u001f", "repo_id", "path"))
        best = P.topk_policies(keyed.select("doc_id", F.col("content").alias("text")), policies, k=1)
        pf = P.policy_findings(keyed.select("doc_id", "repo_id", F.col("path").alias("file")), best)
        stages.append(D.complete_findings(pf.drop("doc_id").withColumn("auto_fixable", F.lit(False))
                                          .withColumn("stage", F.lit("policy")).withColumn("stage_order", F.lit(6))
                                          .withColumn("seq", F.lit(1).cast("long"))))

    findings = S.dedup_findings(S.union_findings(*stages))
    findings = B.stage_filter(findings, scope)
    if config is not None:
        findings = B.apply_config(findings, config)
    if persist:
        findings = materialize(findings, "findings")

    all_repos = repos if repos is not None else scoped.select("repo_id").distinct()
    candidates = X.fix_candidates(findings)
    if config is not None:
        gate = X.fix_gate(findings, config).filter(F.col("decision_root") == "generate_fixes").select("repo_id")
        candidates = X.safe_only(candidates.join(gate, "repo_id", "left_semi"), config)
    fixes = X.valid_fixes(candidates)
    if approvals is not None:
        fixes = X.approved(fixes, approvals)
    errors.append(X.fix_errors(candidates).select("repo_id", F.lit(None).cast("string").alias("path"), "error"))
    return Review(
        findings=findings,
        scores=S.repo_scores(findings, all_repos),
        prioritized=S.prioritize(findings),
        severity_counts=S.severity_counts(findings, all_repos),
        category_heat=S.category_heat(findings),
        top5=S.top_k(findings, 5),
        quick_wins=S.quick_wins(findings, 3),
        fix_candidates=candidates,
        fixes=fixes,
        prompts=prompts,
        markdown=RP.markdown_lines(findings, all_repos),
        json=RP.json_lines(findings, all_repos),
        errors=_union(errors),
        progress=S.progress_counts(scoped, capped),
    )


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
