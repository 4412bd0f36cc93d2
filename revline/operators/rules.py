"""Text rules, dependency advisories, secret masking, policy rules.

Rules are a short driver-side list, so they are folded into one projection (an array of
matches per line) instead of a join: no cross product, no broadcast, one pass over the text.
Whole documents are tested with one combined regex first; only matching documents are split
into lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revline.functions.text import SECRET_PATTERNS, mask_secrets, normalize_newlines, split_lines
from revline.operators.advisories import hits as advisory_hits
from revline.operators.detectors import complete_findings
from revline.operators.lexer import placed
from revline.operators.rule_tables import rule_table, scan_rule_table, violations
from revline.schema import STAGE_ORDER

# Rule set used by the registered queries (ours; the reference's scanner is a stub).
# ``literal``: a substring every match contains; lines without it skip the regex.
DEFAULT_RULES = [
    {"rule_id": "hardcoded-token", "regex": r'token = "[0-9a-f]{40}"', "literal": 'token = "', "severity": "high",
     "cwe_id": "CWE-798", "title": "Hard-coded token"},
    {"rule_id": "sk-secret", "regex": SECRET_PATTERNS[0][1], "literal": "sk-", "severity": "critical",
     "cwe_id": "CWE-798", "title": "API key in source"},
    {"rule_id": "key-param", "regex": SECRET_PATTERNS[1][1], "literal": "key=", "severity": "high",
     "cwe_id": "CWE-598", "title": "Key passed in URL parameter"},
    {"rule_id": "os-system", "regex": r"os\.system\(", "literal": "os.system(", "severity": "high",
     "cwe_id": "CWE-78", "title": "Shell command execution"},
    {"rule_id": "eval-call", "regex": r"\beval\(", "literal": "eval(", "severity": "high",
     "cwe_id": "CWE-95", "title": "Use of eval"},
]


def _rule_struct(rule: dict) -> Column:
    return F.struct(*[F.lit(rule[k]).alias(k) for k in ("rule_id", "severity", "cwe_id", "title")])


def scan_rules(docs: DataFrame, rules=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per (document, line, rule) match: key, line_no, rule_id, severity, cwe_id, title."""
    rules = list(rules or DEFAULT_RULES)

    def hit(c, r):
        m = c.rlike(r["regex"])
        return (c.contains(r["literal"]) & m) if r.get("literal") else m

    def any_hit(c):
        out = None
        for r in rules:
            out = hit(c, r) if out is None else out | hit(c, r)
        return out

    # Document prefilter on the raw text with the rules' literals only: a line is a substring of
    # its document, so a document without any literal cannot have a matching line (exact). A rule
    # without a literal disables the prefilter. Regexes run per line, after normalisation.
    literals = [r.get("literal") for r in rules]
    cand = docs.select(key, F.col(text).alias("_raw"))
    if all(literals):
        cond = None
        for lit_ in literals:
            cond = F.col("_raw").contains(lit_) if cond is None else cond | F.col("_raw").contains(lit_)
        cand = cand.filter(cond)
    lines = cand.select(key, F.posexplode(split_lines(normalize_newlines("_raw"))).alias("_pos", "_line")) \
        .filter(any_hit(F.col("_line")))
    matches = F.filter(F.array(*[F.when(hit(F.col("_line"), r), _rule_struct(r)) for r in rules]),
                       lambda x: x.isNotNull())
    return lines.select(key, (F.col("_pos") + 1).alias("line_no"), F.explode(matches).alias("r")) \
        .select(key, "line_no", "r.*")


def secret_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """D11 detection: matches per document and pattern (documents without any match omitted)."""
    arr = F.array(*[F.struct(F.lit(name).alias("kind"), F.regexp_count(F.col(text), F.lit(rx)).alias("n"))
                    for name, rx in SECRET_PATTERNS])
    return docs.select(key, F.explode(arr).alias("s")).select(key, "s.kind", "s.n").filter(F.col("n") > 0)


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Text with both secret patterns masked in order."""
    return docs.select(key, mask_secrets(text).alias("masked_text"))


# Policy rules for D16 (ours): a document must or must not match a pattern.
DEFAULT_POLICY_RULES = [
    {"rule_id": "no-hardcoded-token", "must_not_match": r'token = "[0-9a-f]{40}"'},
    {"rule_id": "license-header", "must_match": r"(?m)^.*License.*$"},
]


def policy_violations(docs: DataFrame, rules=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule_id) for every document that breaks a policy rule."""
    rules = list(rules or DEFAULT_POLICY_RULES)
    checks = []
    for r in rules:
        if "must_match" in r:
            bad = ~F.col(text).rlike(r["must_match"])
        else:
            bad = F.col(text).rlike(r["must_not_match"])
        checks.append(F.when(bad, F.lit(r["rule_id"])))
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return docs.select(key, F.explode(arr).alias("rule_id"))


# ---- as findings of a review ------------------------------------------------------------------

def _staged(df: DataFrame, stage: str) -> DataFrame:
    return complete_findings(df.withColumn("stage", F.lit(stage)).withColumn("category", F.lit(stage))
                             .withColumn("stage_order", F.lit(STAGE_ORDER[stage]))
                             .withColumn("seq", F.coalesce("line", F.lit(0)).cast("long")))


def _file_key(files: DataFrame) -> DataFrame:
    return files.withColumn("_key", F.struct("repo_id", "path"))


def rule_findings(files: DataFrame, rules=None, places=None) -> DataFrame:
    """Rule matches of ``files(repo_id, path, content)`` as security findings; ``rules`` a list or a table.

    ``places``: keep matches that start there only (of code, comment and string; see ``operators.lexer``).
    """
    scan = scan_rule_table if isinstance(rules, DataFrame) else scan_rules
    hits = scan(_file_key(files), rules, key="_key", text="content")
    if places is not None:
        table = rules if isinstance(rules, DataFrame) else rule_table(files.sparkSession, rules or DEFAULT_RULES)
        where = placed(hits.select("_key.repo_id", "_key.path", "line_no", "rule_id", "severity", "cwe_id", "title"), files,
                       table.select("rule_id", "regex").distinct())
        hits = where.where(F.col("place").isin(list(places))).withColumn("_key", F.struct("repo_id", "path"))
    return _staged(hits.select("_key.repo_id", F.col("_key.path").alias("file"), F.col("line_no").alias("line"), "severity", "title",
                               F.format_string("%s (%s)", "title", "rule_id").alias("description"), "cwe_id"), "security")


def advisory_findings(requirements: DataFrame, advisories: DataFrame) -> DataFrame:
    """Vulnerable requirements ``(repo_id, path, name, version)`` as security findings."""
    hits = advisory_hits(requirements, advisories)
    return _staged(hits.select("repo_id", F.col("path").alias("file"), F.lit(None).cast("int").alias("line"), "severity",
                               F.format_string("Vulnerable dependency: %s", "name").alias("title"),
                               F.format_string("%s %s: %s", "name", "version", F.col("advisory_id").cast("string"))
                               .alias("description")), "security")


def policy_rule_findings(files: DataFrame, rules=None, severity: str = "medium") -> DataFrame:
    """Broken policy rules (a list or a table) as findings of the policy stage."""
    check = violations if isinstance(rules, DataFrame) else policy_violations
    broken = check(_file_key(files), rules, key="_key", text="content")
    return _staged(broken.select("_key.repo_id", F.col("_key.path").alias("file"), F.lit(1).alias("line"),
                                 F.lit(severity).alias("severity"), F.format_string("Policy rule broken: %s", "rule_id").alias("title"),
                                 F.col("rule_id").alias("description")), "policy")
