"""DuckDB SQL oracles: expected results recomputed from the table parameters, never by parsing.

Each string runs on the driver tables registered as views. Shared pieces are CTE text builders.
"""

from __future__ import annotations

import re

from revline.functions.ids import finding_id_sql

# Generated source files (see revline.sources.gen.gen_source_files): k, size, variant, repo, path.
GEN_PARAMS = """
gp AS (
  SELECT p_partkey AS k, p_size AS s, p_partkey % 8 AS v,
         CAST(p_partkey % 50 AS VARCHAR) AS repo_id,
         'src/m' || CAST(p_partkey AS VARCHAR) || '.py' AS file
  FROM part)"""


def _gen_rows(kinds: list[str]) -> str:
    parts = {
        "long_function": """
  SELECT repo_id, file, CASE WHEN v = 6 THEN 2 ELSE 1 END AS line, 'medium' AS severity, 'pattern' AS category,
         'pattern' AS stage, 'Long Function' AS title,
         'Function ''' || CASE WHEN v = 6 THEN 'g' ELSE 'f' END || ''' is ' || CAST(2 * s AS VARCHAR)
           || ' lines long (>50)' AS description, TRUE AS auto_fixable
  FROM gp WHERE v IN (0, 6) AND 2 * s > 50""",
        "too_many_parameters": """
  SELECT repo_id, file, 1, 'medium', 'pattern', 'pattern', 'Too Many Parameters',
         'Function ''f'' has ' || CAST(s % 10 AS VARCHAR) || ' parameters (>5)', TRUE
  FROM gp WHERE v = 1 AND s % 10 > 5""",
        "god_class": """
  SELECT repo_id, file, 1, 'medium', 'pattern', 'pattern', 'God Class',
         'Class ''C'' is ' || CAST(20 * s AS VARCHAR) || ' lines long (>500)', TRUE
  FROM gp WHERE v = 3 AND 20 * s > 500""",
        "magic_number": """
  SELECT repo_id, file, 101, 'medium', 'pattern', 'pattern', 'Magic Number',
         'Potential magic number detected', TRUE
  FROM gp WHERE v = 0 AND s = 50""",
        "complexity": """
  SELECT repo_id, file, 1, 'high', 'performance', 'performance', 'High Cyclomatic Complexity',
         'Function f has complexity ' || CAST(s % 15 + 1 AS VARCHAR), FALSE
  FROM gp WHERE v = 7 AND s % 15 + 1 > 10""",
        "unsafe_call": """
  SELECT repo_id, file, CAST(NULL AS INTEGER), 'high', 'security', 'security', 'Unsafe system call',
         'Possible shell injection vulnerability using os.system', FALSE
  FROM gp WHERE v = 5""",
        "missing_docstring": """
  SELECT repo_id, file, CAST(NULL AS INTEGER), 'low', 'style', 'static', 'Missing docstring',
         'File or function is missing a docstring.', FALSE
  FROM gp WHERE v NOT IN (4, 6)""",
    }
    names = ["line", "severity", "category", "stage", "title", "description", "auto_fixable"]
    rows = []
    for kind in kinds:
        body = parts[kind]
        sel, rest = body.split("FROM gp", 1)
        # re-alias positional columns so any branch can come first
        items = _split_top(sel.strip()[len("SELECT"):])
        items = items[:2] + [f"{_strip_alias(x)} AS {n}" for x, n in zip(items[2:], names)]
        rows.append("\n  SELECT " + ", ".join(items) + " FROM gp" + rest)
    return "\nUNION ALL".join(rows)


def _split_top(sel: str) -> list[str]:
    out, depth, cur, quote = [], 0, "", False
    for ch in sel:
        if ch == "'":
            quote = not quote
        if not quote:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 0:
                out.append(cur.strip())
                cur = ""
                continue
        cur += ch
    out.append(cur.strip())
    return out


def _strip_alias(x: str) -> str:
    m = re.match(r"^(.*?)\s+AS\s+\w+$", x, re.S)
    return m.group(1) if m and x.count("'") % 2 == 0 and not x.rstrip().endswith("'") else x


def gen_findings_cte(kinds: list[str], name: str = "gf") -> str:
    """CTE ``name`` with the expected findings of the chosen detectors plus their ids."""
    body = _gen_rows(kinds)
    return f"""{GEN_PARAMS},
{name}_raw AS ({body}
),
{name} AS (
  SELECT *, CAST(NULL AS INTEGER) AS "column", {finding_id_sql()} AS id FROM (
    SELECT repo_id, file, CAST(line AS INTEGER) AS line, severity, category, stage, title, description,
           auto_fixable FROM {name}_raw))"""


ALL_KINDS = ["long_function", "too_many_parameters", "god_class", "magic_number", "complexity",
             "unsafe_call", "missing_docstring"]
SMELL_KINDS = ["long_function", "too_many_parameters", "god_class", "magic_number"]

SCORE_COLS = """
  CAST(100 - coalesce(penalty, 0) AS INTEGER) AS score"""


def scores_sql(findings_cte: str, findings: str, repos_sql: str | None = None) -> str:
    base = f"""SELECT repo_id, CAST(count(*) AS BIGINT) AS n_findings,
         CAST(sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5
                           WHEN 'low' THEN 2 ELSE 0 END) AS BIGINT) AS penalty
  FROM {findings} GROUP BY repo_id"""
    if repos_sql:
        base = f"""SELECT r.repo_id, coalesce(a.n_findings, 0) AS n_findings, a.penalty
  FROM ({repos_sql}) r LEFT JOIN ({base}) a ON r.repo_id = a.repo_id"""
    return f"""WITH {findings_cte},
agg AS ({base}),
sc AS (SELECT repo_id, CAST(n_findings AS BIGINT) AS n_findings, {SCORE_COLS} FROM agg)
SELECT repo_id, n_findings, score,
  CASE WHEN score >= 90 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 80 THEN 'B+'
       WHEN score >= 75 THEN 'B' WHEN score >= 65 THEN 'C' ELSE 'F' END AS grade_root,
  CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C'
       WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade_src,
  CASE WHEN (CASE WHEN score >= 90 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 80 THEN 'B+'
       WHEN score >= 75 THEN 'B' WHEN score >= 65 THEN 'C' ELSE 'F' END) LIKE '%A%' THEN 'green'
       WHEN (CASE WHEN score >= 90 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 80 THEN 'B+'
       WHEN score >= 75 THEN 'B' WHEN score >= 65 THEN 'C' ELSE 'F' END) LIKE '%B%' THEN 'yellow'
       ELSE 'red' END AS colour
FROM sc"""


ORACLES: dict[str, str] = {}

ORACLES["repo_scores"] = scores_sql(
    gen_findings_cte(ALL_KINDS), "gf",
    repos_sql="SELECT DISTINCT CAST(p_partkey % 50 AS VARCHAR) AS repo_id FROM part")


ORACLES["line_counts"] = """
SELECT doc_id, CAST(len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS INTEGER) AS total_lines
FROM documents"""

ORACLES["function_facts"] = f"""WITH {GEN_PARAMS}
SELECT repo_id, file AS path, 'f' AS name, 1 AS line, CAST(2 * s + 1 AS INTEGER) AS end_line, 1 AS n_args,
       'a' AS args_list, 1 AS complexity FROM gp WHERE v = 0
UNION ALL
SELECT repo_id, file, 'f', 1, 2, CAST(s % 10 AS INTEGER),
       array_to_string(list_transform(range(1, s % 10 + 1), lambda i: 'p' || CAST(i AS VARCHAR)), ','), 1
FROM gp WHERE v = 1
UNION ALL
SELECT repo_id, file, 'g', 2, CAST(2 * s + 2 AS INTEGER), 1, 'a', 1 FROM gp WHERE v = 6
UNION ALL
SELECT repo_id, file, 'f', 1, CAST(s % 15 + 2 AS INTEGER), 1, 'a', CAST(s % 15 + 1 AS INTEGER) FROM gp WHERE v = 7"""

ORACLES["class_facts"] = f"""WITH {GEN_PARAMS}
SELECT repo_id, file AS path, 'C' AS name, 1 AS line, CAST(20 * s + 1 AS INTEGER) AS end_line, 0 AS n_methods
FROM gp WHERE v = 3"""

ORACLES["import_facts"] = f"""WITH {GEN_PARAMS}
SELECT repo_id, file AS path, 'os' AS module FROM gp WHERE v = 5"""

ORACLES["call_facts"] = f"""WITH {GEN_PARAMS}
SELECT repo_id, file AS path, 'os.system' AS name, 2 AS line, 0 AS loop_depth FROM gp WHERE v = 5"""

ORACLES["parse_errors"] = f"""WITH {GEN_PARAMS}
SELECT repo_id, file AS path, 'Syntax error at line 1: invalid syntax' AS error, 1 AS error_line
FROM gp WHERE v = 4"""

ORACLES["syntax_check"] = f"""WITH {GEN_PARAMS}
SELECT repo_id, file AS path, v <> 4 AS valid FROM gp"""

_FOUT = "id, repo_id, file, line, severity, category, title, description, auto_fixable"

ORACLES["smell_findings"] = f"WITH {gen_findings_cte(SMELL_KINDS)}\nSELECT {_FOUT} FROM gf"
ORACLES["complexity_findings"] = f"WITH {gen_findings_cte(['complexity'])}\nSELECT {_FOUT} FROM gf"
ORACLES["script_findings"] = f"WITH {gen_findings_cte(['unsafe_call', 'missing_docstring'])}\nSELECT {_FOUT} FROM gf"
ORACLES["all_findings"] = f"""WITH {gen_findings_cte(ALL_KINDS)}
SELECT DISTINCT {_FOUT}, stage,
  CAST(list_position(['static','pattern','security','performance','testing','logic','policy'], stage) - 1 AS INTEGER)
    AS stage_order
FROM gf"""

# Lint reports: issue j = 1..k%4 of file k (k % 10 <> 0); message type ((k + j) % 4).
_LINT = """
li AS (
  SELECT CAST(p_partkey % 50 AS VARCHAR) AS repo_id, 'src/m' || CAST(p_partkey AS VARCHAR) || '.py' AS file,
         p_partkey AS k, unnest(range(1, CAST(p_partkey % 4 AS INTEGER) + 1)) AS j
  FROM part WHERE p_partkey % 10 <> 0)"""

ORACLES["lint_findings"] = f"""WITH {_LINT},
lf AS (
  SELECT repo_id, file, CAST(j AS INTEGER) AS line, CAST(j - 1 AS INTEGER) AS "column",
         ['convention', 'refactor', 'warning', 'error'][CAST((k + j) % 4 AS INTEGER) + 1] AS severity,
         'style' AS category, 'Lint Issue: symbol-' || CAST(j AS VARCHAR) AS title,
         'message ' || CAST(j AS VARCHAR) AS description
  FROM li)
SELECT {finding_id_sql()} AS id, repo_id, file, line, severity, title, description FROM lf"""

ORACLES["lint_errors"] = """
SELECT CAST(p_partkey % 50 AS VARCHAR) AS repo_id, 'src/m' || CAST(p_partkey AS VARCHAR) || '.py' AS path,
       'Pylint timeout' AS error
FROM part WHERE p_partkey % 10 = 0"""

_CX = """
cx AS (
  SELECT CAST(p_partkey % 50 AS VARCHAR) AS repo_id, 'src/m' || CAST(p_partkey AS VARCHAR) || '.py' AS path,
         p_size AS s, unnest(range(0, CAST(p_partkey % 3 AS INTEGER) + 1)) AS j
  FROM part WHERE p_partkey % 10 <> 0)"""

ORACLES["complexity_report"] = f"""WITH {_CX}
SELECT repo_id, path, 'fn' || CAST(j AS VARCHAR) AS name, CAST(j * 10 + 1 AS INTEGER) AS lineno,
       CAST((s + j * 7) % 20 + 1 AS INTEGER) AS complexity, CAST(NULL AS VARCHAR) AS error FROM cx
UNION ALL
SELECT CAST(p_partkey % 50 AS VARCHAR), 'src/m' || CAST(p_partkey AS VARCHAR) || '.py', NULL, NULL, NULL,
       'could not parse'
FROM part WHERE p_partkey % 10 = 0"""

ORACLES["complexity_report_findings"] = f"""WITH {_CX},
cf AS (
  SELECT repo_id, path AS file, CAST(j * 10 + 1 AS INTEGER) AS line, CAST(NULL AS INTEGER) AS "column",
         'performance' AS category, 'High Cyclomatic Complexity' AS title,
         'Function fn' || CAST(j AS VARCHAR) || ' has complexity ' || CAST((s + j * 7) % 20 + 1 AS VARCHAR) AS description
  FROM cx WHERE (s + j * 7) % 20 + 1 > 10)
SELECT {finding_id_sql()} AS id, repo_id, file, line, title, description FROM cf"""

_SECRET = """
st AS (
  SELECT doc_id, text || ' sk-' || md5(CAST(doc_id AS VARCHAR)) || ' key='
         || substr(md5(CAST(doc_id + 1 AS VARCHAR)), 1, CAST(18 + doc_id % 4 AS INTEGER)) AS text
  FROM documents)"""

ORACLES["secret_mask"] = f"""WITH {_SECRET}
SELECT doc_id, regexp_replace(regexp_replace(text, '(sk-)[a-zA-Z0-9]{{32,}}', '\\1********', 'g'),
                              '(key=)[a-zA-Z0-9-_]{{20,}}', '\\1********', 'g') AS masked_text
FROM st"""

ORACLES["secret_findings"] = f"""WITH {_SECRET},
c AS (
  SELECT doc_id, 'sk_token' AS kind, CAST(len(regexp_extract_all(text, '(sk-)[a-zA-Z0-9]{{32,}}')) AS INTEGER) AS n FROM st
  UNION ALL
  SELECT doc_id, 'key_param', CAST(len(regexp_extract_all(text, '(key=)[a-zA-Z0-9-_]{{20,}}')) AS INTEGER) FROM st)
SELECT doc_id, kind, n FROM c WHERE n > 0"""

ORACLES["rule_findings"] = f"""WITH {_SECRET},
ln AS (
  SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM st)),
rules(rule_id, rx, severity, cwe_id, title) AS (VALUES
  ('hardcoded-token', 'token = "[0-9a-f]{{40}}"', 'high', 'CWE-798', 'Hard-coded token'),
  ('sk-secret', '(sk-)[a-zA-Z0-9]{{32,}}', 'critical', 'CWE-798', 'API key in source'),
  ('key-param', '(key=)[a-zA-Z0-9-_]{{20,}}', 'high', 'CWE-598', 'Key passed in URL parameter'),
  ('os-system', 'os\\.system\\(', 'high', 'CWE-78', 'Shell command execution'),
  ('eval-call', '\\beval\\(', 'high', 'CWE-95', 'Use of eval'))
SELECT doc_id, line_no, rule_id, severity, cwe_id, title
FROM ln JOIN rules ON regexp_matches(line, rx)"""

ORACLES["advisory_hits"] = """
WITH req AS (
  SELECT 'pkg' || regexp_extract(p_brand, '(\\d+)', 1) AS name,
         CAST(p_size % 5 AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) || '.' || CAST(p_size % 7 AS VARCHAR) AS version,
         'src/m' || CAST(p_partkey AS VARCHAR) || '.py' AS path
  FROM part),
b AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS b FROM part),
adv AS (
  SELECT 'pkg' || CAST(b AS VARCHAR) AS name, 'ADV-' || CAST(b AS VARCHAR) || '-1' AS advisory_id,
         [b % 5, 0, 0] AS lo, [b % 5, 5, 0] AS hi, 'high' AS severity FROM b
  UNION ALL
  SELECT 'pkg' || CAST(b AS VARCHAR), 'ADV-' || CAST(b AS VARCHAR) || '-2', [3, b % 10, 0], [4, 0, 0], 'critical' FROM b)
SELECT path, req.name, version, advisory_id, severity
FROM req JOIN adv ON req.name = adv.name
WHERE list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER)) >= adv.lo
  AND list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER)) < adv.hi"""

ORACLES["policy_violations"] = """
SELECT doc_id, 'no-hardcoded-token' AS rule_id FROM documents WHERE regexp_matches(text, 'token = "[0-9a-f]{40}"')
UNION ALL
SELECT doc_id, 'license-header' FROM documents WHERE NOT regexp_matches(text, '(?m)^.*License.*$')"""

_SCOPE = """
sp AS (
  SELECT CAST(p_partkey % 50 AS VARCHAR) AS repo_id,
         ['src', 'src/node_modules/lib', '.github/workflows', 'pkg/.git/hooks', 'vendor/x', 'tests', 'logs/old',
          '.cache/a', 'src/.gemini', 'lib/util'][CAST(p_partkey % 10 AS INTEGER) + 1] AS dir,
         '/m' || CAST(p_partkey AS VARCHAR)
         || ['.py', '.py', '.spec.py', '.test.js', '.java', '.ts', '.tsx', '.py', '.md', '.py'][CAST(p_size % 10 AS INTEGER) + 1] AS fname
  FROM part),
scoped AS (
  SELECT repo_id, dir || fname AS path FROM sp
  WHERE fname LIKE '%.py'
    AND NOT (contains(dir, 'node_modules') OR contains(dir, '.git') OR contains(dir, '.gemini')
             OR contains(dir, '.cache') OR contains(dir, 'logs'))
    AND NOT (('/' || dir || '/') LIKE '%/node_modules/%' OR ('/' || dir || '/') LIKE '%/vendor/%'
             OR fname LIKE '%.test.js' OR fname LIKE '%.spec.py'))"""

ORACLES["scope_files"] = f"WITH {_SCOPE}\nSELECT repo_id, path FROM scoped"

ORACLES["file_cap"] = f"""WITH {_SCOPE},
n AS (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rn,
             count(*) OVER (PARTITION BY repo_id) AS total_files FROM scoped)
SELECT repo_id, path, CAST(total_files AS BIGINT) AS total_files,
       CAST(least(total_files, 10) AS BIGINT) AS files_analyzed
FROM n WHERE rn <= 10"""

_CFG = """
cfg AS (
  SELECT CAST(c_custkey AS VARCHAR) AS repo_id,
    CASE WHEN c_custkey % 3 = 1 THEN CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'high' WHEN 'BUILDING' THEN 'low'
                                      WHEN 'FURNITURE' THEN 'critical' WHEN 'MACHINERY' THEN 'info' ELSE 'medium' END
         WHEN c_custkey % 3 = 2 AND c_mktsegment = 'HOUSEHOLD' THEN NULL
         ELSE 'medium' END AS severity_threshold,
    CASE WHEN c_custkey % 3 = 2 THEN ['security_audit', 'performance_analysis']
         ELSE ['static_analysis', 'security_audit', 'performance_analysis', 'pattern_analysis',
               'testing_assessment', 'logic_verification'] END AS enabled_checks,
    CASE WHEN c_custkey % 3 = 1 THEN c_acctbal > 0 ELSE TRUE END AS auto_fix_enabled,
    CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE TRUE END AS auto_fix_safe_only,
    600 AS max_analysis_time,
    CASE WHEN c_custkey % 3 = 2 THEN ['style'] END AS skip_categories
  FROM customer)"""

ORACLES["config_effective"] = f"""WITH {_CFG}
SELECT repo_id, severity_threshold, array_to_string(enabled_checks, ',') AS enabled_checks, auto_fix_enabled,
       auto_fix_safe_only, max_analysis_time, array_to_string(skip_categories, ',') AS skip_categories
FROM cfg"""


def orders_findings_cte(name: str = "of") -> str:
    """Findings generated from orders (revline.sources.gen.gen_findings_orders)."""
    return f"""
{name}_raw AS (
  SELECT CAST(o_custkey AS VARCHAR) AS repo_id, 'orders/' || o_orderstatus || '.py' AS file,
         CAST(dayofmonth(o_orderdate) AS INTEGER) AS line, CAST(NULL AS INTEGER) AS "column",
         CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
              WHEN '5-LOW' THEN 'low' WHEN '4-NOT SPECIFIED' THEN 'info' END AS severity,
         ['static', 'pattern', 'security', 'performance', 'testing', 'logic', 'policy'][CAST(o_orderkey % 7 AS INTEGER) + 1] AS stage,
         ['style', 'pattern', 'security', 'performance', 'testing', 'logic', 'policy'][CAST(o_orderkey % 7 AS INTEGER) + 1] AS category,
         'Priority ' || o_orderpriority || CASE WHEN o_orderkey % 9 = 0 THEN chr(10) || ')' ELSE '' END AS title,
         'order ' || CAST(o_orderkey AS VARCHAR) AS description,
         o_orderstatus <> 'P' AS auto_fixable,
         CAST(o_orderkey % 7 AS INTEGER) AS stage_order,
         CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 10000000000 + o_orderkey AS seq,
         o_orderkey
  FROM orders),
{name} AS (SELECT *, {finding_id_sql()} AS id FROM {name}_raw)"""


SEV_RANK = """CASE {c} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3
  WHEN 'info' THEN 4 WHEN NULL THEN 4 ELSE CASE WHEN {c} IS NULL THEN 4 ELSE 5 END END"""


def sev_rank(c: str) -> str:
    return SEV_RANK.format(c=c)


ORACLES["threshold_filter"] = f"""WITH {orders_findings_cte()}, {_CFG},
stages AS (
  SELECT repo_id, severity_threshold, coalesce(skip_categories, []) AS skip,
         list_transform(enabled_checks, lambda c: CASE c WHEN 'static_analysis' THEN 'static'
            WHEN 'pattern_analysis' THEN 'pattern' WHEN 'security_audit' THEN 'security'
            WHEN 'performance_analysis' THEN 'performance' WHEN 'testing_assessment' THEN 'testing'
            WHEN 'logic_verification' THEN 'logic' WHEN 'policy_verification' THEN 'policy' END) AS st
  FROM cfg)
SELECT id, f.repo_id, severity, stage
FROM of f LEFT JOIN stages s ON f.repo_id = s.repo_id
WHERE (severity_threshold IS NULL OR {sev_rank('severity')} <= {sev_rank('severity_threshold')}
       OR ({sev_rank('severity')} = 5 AND {sev_rank('severity_threshold')} = 4))
  AND coalesce(list_contains(st, stage) OR stage = 'policy', true) AND NOT coalesce(list_contains(skip, category), false)"""


# ---- synthesis over generated findings -------------------------------------------------------------
def events_findings_cte(name: str = "ef") -> str:
    return f"""
{name}_raw AS (
  SELECT concat_ws('/', CAST(user_id AS VARCHAR), strftime(ts, '%Y%m%d%H')) AS repo_id,
         'events/' || event_type || '.py' AS file, CAST(event_id % 1000 AS INTEGER) AS line,
         CAST(NULL AS INTEGER) AS "column",
         CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium'
              WHEN 'view' THEN 'low' WHEN 'signup' THEN 'info' END AS severity,
         ['static', 'pattern', 'security', 'performance', 'testing', 'logic', 'policy'][CAST(event_id % 7 AS INTEGER) + 1] AS stage,
         ['style', 'pattern', 'security', 'performance', 'testing', 'logic', 'policy'][CAST(event_id % 7 AS INTEGER) + 1] AS category,
         'Event ' || event_type AS title, 'event ' || CAST(event_id AS VARCHAR) AS description,
         value > 50 AS auto_fixable, CAST(event_id % 7 AS INTEGER) AS stage_order, event_id AS seq
  FROM events),
{name} AS (SELECT *, {finding_id_sql()} AS id FROM {name}_raw)"""


_PRI = f"{sev_rank('severity')}, stage_order, seq, id"

ORACLES["prioritized"] = f"""WITH {orders_findings_cte()}
SELECT id, repo_id, severity, row_number() OVER (PARTITION BY repo_id ORDER BY {_PRI}) AS priority FROM of"""

ORACLES["prioritized_alpha"] = f"""WITH {orders_findings_cte()}
SELECT id, repo_id, severity, row_number() OVER (PARTITION BY repo_id ORDER BY severity, stage_order, seq, id) AS priority
FROM of"""

ORACLES["event_scores"] = scores_sql(events_findings_cte(), "ef")
ORACLES["order_scores"] = scores_sql(orders_findings_cte(), "of",
                                     repos_sql="SELECT CAST(c_custkey AS VARCHAR) AS repo_id FROM customer")

ORACLES["severity_counts"] = f"""WITH {events_findings_cte()},
r AS (SELECT DISTINCT repo_id FROM ef),
s(severity) AS (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info'))
SELECT r.repo_id, s.severity, CAST(count(ef.id) AS BIGINT) AS n
FROM r CROSS JOIN s LEFT JOIN ef ON ef.repo_id = r.repo_id AND coalesce(ef.severity, 'info') = s.severity
GROUP BY r.repo_id, s.severity
UNION ALL
SELECT repo_id, severity, CAST(count(*) AS BIGINT) FROM ef
WHERE coalesce(severity, 'info') NOT IN ('critical', 'high', 'medium', 'low', 'info') GROUP BY repo_id, severity"""

ORACLES["total_issues"] = f"""WITH {events_findings_cte()}
SELECT repo_id, CAST(count(*) AS BIGINT) AS total_issues FROM ef GROUP BY repo_id"""

ORACLES["category_heat"] = f"""WITH {events_findings_cte()},
r AS (SELECT DISTINCT repo_id FROM ef),
s(stage) AS (VALUES ('static'), ('pattern'), ('security'), ('performance'), ('logic')),
c AS (SELECT r.repo_id, s.stage, CAST(count(ef.id) AS BIGINT) AS n
      FROM r CROSS JOIN s LEFT JOIN ef ON ef.repo_id = r.repo_id AND ef.stage = s.stage GROUP BY r.repo_id, s.stage)
SELECT repo_id, upper(substr(stage, 1, 1)) || substr(stage, 2) AS category, n,
       CASE WHEN n < 5 THEN 'LOW' WHEN n < 15 THEN 'MED' ELSE 'HIGH' END AS heat
FROM c"""

ORACLES["stage_counts"] = f"""WITH {events_findings_cte()},
r AS (SELECT DISTINCT repo_id FROM ef),
s(stage) AS (VALUES ('static'), ('pattern'), ('security'), ('performance'), ('testing'), ('logic'), ('policy'))
SELECT r.repo_id, s.stage, CAST(count(ef.id) AS BIGINT) AS n
FROM r CROSS JOIN s LEFT JOIN ef ON ef.repo_id = r.repo_id AND ef.stage = s.stage GROUP BY r.repo_id, s.stage"""

ORACLES["top5_per_repo"] = f"""WITH {orders_findings_cte()},
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY {_PRI}) AS INTEGER) AS pos FROM of)
SELECT repo_id, pos, id, severity,
       CAST(pos AS VARCHAR) || '. [' || upper(severity) || '] ' || coalesce(title, 'Untitled') AS headline,
       coalesce(file, 'Unknown file') || ':' || coalesce(CAST(line AS VARCHAR), '?') AS location
FROM t WHERE pos <= 5"""

ORACLES["quick_wins"] = f"""WITH {orders_findings_cte()},
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY {_PRI}) AS INTEGER) AS pos FROM of WHERE auto_fixable)
SELECT repo_id, pos, id, severity, title FROM t WHERE pos <= 3"""

ORACLES["fix_gate"] = f"""WITH {orders_findings_cte()}, {_CFG},
u AS (SELECT repo_id, bool_or(severity IN ('critical', 'high') AND auto_fixable) AS h FROM of GROUP BY repo_id)
SELECT c.repo_id,
       CASE WHEN coalesce(c.auto_fix_enabled, FALSE) AND coalesce(u.h, FALSE) THEN 'generate_fixes' ELSE 'skip_fixes' END AS decision_root,
       CASE WHEN coalesce(c.auto_fix_enabled, FALSE) THEN 'generate_fixes' ELSE 'skip_fixes' END AS decision_src
FROM cfg c LEFT JOIN u ON c.repo_id = u.repo_id"""

_FIXCODE = "'# Fixed ' || title || chr(10) || 'def fixed_function():' || chr(10) || '    pass'"

ORACLES["fixes"] = f"""WITH {orders_findings_cte()}
SELECT repo_id, id AS issue_id, {_FIXCODE} AS fix_code, 'valid_syntax' AS status
FROM of WHERE auto_fixable AND o_orderkey % 9 <> 0"""

ORACLES["fix_errors"] = f"""WITH {orders_findings_cte()}
SELECT repo_id, id AS issue_id, 'LLM generated invalid syntax for issue ' || id AS error
FROM of WHERE auto_fixable AND o_orderkey % 9 = 0"""

ORACLES["approved_fixes"] = f"""WITH {orders_findings_cte()}
SELECT f.repo_id, f.id AS issue_id, 'valid_syntax' AS status
FROM of f JOIN orders o ON f.o_orderkey = o.o_orderkey
WHERE f.auto_fixable AND f.o_orderkey % 9 <> 0 AND o.o_totalprice > 250000"""

ORACLES["safe_fixes"] = f"""WITH {orders_findings_cte()}, {_CFG}
SELECT f.id AS issue_id, f.repo_id, f.severity, f.o_orderkey % 9 <> 0 AS valid
FROM of f LEFT JOIN cfg c ON f.repo_id = c.repo_id
WHERE f.auto_fixable AND (NOT coalesce(c.auto_fix_safe_only, FALSE) OR f.severity IN ('low', 'info'))"""

ORACLES["test_stubs"] = f"""WITH {gen_findings_cte(SMELL_KINDS)}
SELECT id, file, chr(10) || 'import pytest' || chr(10) || 'from ' || replace(replace(file, '.py', ''), '/', '.')
       || ' import ...' || chr(10) || chr(10) || 'def test_adversarial_logic():' || chr(10)
       || '    # Automatically generated to test: ' || description || chr(10) || '    assert True' || chr(10) AS test_code
FROM gf"""

ORACLES["issue_payloads"] = f"""WITH {gen_findings_cte(SMELL_KINDS)}
SELECT id, repo_id, title, description AS body, severity || ',' || category AS labels FROM gf"""

# ---- versions -------------------------------------------------------------------------------------------
_FV = """
fv AS (
  SELECT CAST(o_custkey AS VARCHAR) AS repo_id, 'f' || CAST(o_orderkey % 7 AS VARCHAR) || '.py' AS path,
         CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS commit_seq,
         o_orderkey AS version_id, 'v = ' || CAST(o_orderkey AS VARCHAR) AS content, o_orderstatus = 'P' AS is_deleted
  FROM orders)"""


def _snap(c: int) -> str:
    return f"""(SELECT repo_id, path, commit_seq, version_id, content FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY commit_seq DESC, version_id DESC) AS rn
      FROM fv WHERE commit_seq <= {c}) WHERE rn = 1 AND NOT is_deleted)"""


_D_FROM, _D_TO = 9862, 10592  # 1997-01-01 and 1999-01-01 as days since the epoch
ORACLES["file_as_of"] = f"WITH {_FV}\nSELECT * FROM {_snap(_D_TO)}"
ORACLES["changed_files"] = f"""WITH {_FV}
SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.path, b.path) AS path,
       CASE WHEN a.content IS NULL THEN 'added' WHEN b.content IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
FROM {_snap(_D_FROM)} a FULL OUTER JOIN {_snap(_D_TO)} b ON a.repo_id = b.repo_id AND a.path = b.path
WHERE a.content IS DISTINCT FROM b.content"""

# ---- policy ----------------------------------------------------------------------------------------------
_PTOP = """
dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
pt0 AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
sc AS (SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS score FROM dt JOIN pt0 pt ON dt.term = pt.term GROUP BY doc_id, item_id),
top AS (SELECT * FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS INTEGER) AS rank,
                              item_id, score FROM sc) WHERE rank <= 3)"""

ORACLES["policy_topk"] = f"WITH {_PTOP}\nSELECT * FROM top"

_PFIND = f"""{_PTOP},
pf AS (
  SELECT d.doc_id, 'docs/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS file, 1 AS line, 'info' AS severity,
         'policy' AS category, 'Applied Local Policy' AS title,
         'Verified against standard: ' || coalesce('policy ' || CAST(t.item_id AS VARCHAR), 'no matching policy') AS description
  FROM documents d LEFT JOIN (SELECT * FROM top WHERE rank = 1) t ON d.doc_id = t.doc_id)"""

ORACLES["policy_findings"] = f"WITH {_PFIND}\nSELECT * FROM pf"
ORACLES["policy_run_check"] = f"""WITH {_PFIND}
SELECT CAST(count(*) AS BIGINT) AS n_policy_findings, min_by(file, doc_id) AS first_file,
       min_by(description, doc_id) AS first_description FROM pf"""
ORACLES["policy_index"] = "SELECT 'Indexed ' || CAST(count(*) AS VARCHAR) || ' policy documents.' AS message FROM benchmark"

ORACLES["embedding_topk"] = """
WITH u AS (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM u GROUP BY label, i)
      GROUP BY label),
s AS (SELECT e.vec_id, c.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.centroid) AS sim
      FROM embeddings e CROSS JOIN c)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, label, round(sim, 4) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rank FROM s) WHERE rank <= 3"""

# ---- prompts ---------------------------------------------------------------------------------------------


def _persona_case() -> str:
    from revline.operators.prompts import DEFAULT_PERSONA, PERSONA_PROMPTS
    q = lambda s: "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in PERSONA_PROMPTS.items())
    return f"CASE persona_id {whens} ELSE {q(PERSONA_PROMPTS[DEFAULT_PERSONA])} END"


def _instruction() -> str:
    from revline.operators.prompts import INSTRUCTION_SRC
    return INSTRUCTION_SRC.replace("'", "''")


ORACLES["persona_prompts"] = f"""
WITH d AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN 'architect' WHEN 'de' THEN 'mentor' WHEN 'fr' THEN 'security'
                                    ELSE 'reviewer' END AS persona_id FROM documents)
SELECT doc_id, persona_id, {_persona_case()} || chr(10) || '{_instruction()}' AS system_prompt,
       'File: docs/' || CAST(doc_id AS VARCHAR) || '.txt' || chr(10) || chr(10) || 'Code:' || chr(10) || text AS human_prompt
FROM d"""

ORACLES["logic_findings"] = """
WITH u AS (SELECT conv_id, turn, 'conv/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS path
           FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS response FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn, path AS file, 1 AS line, 'medium' AS severity, 'logic' AS category,
       'Logic Intelligence Scan' AS title, substr(response, 1, 200) || '...' AS description,
       response AS recommendation, TRUE AS auto_fixable
FROM u JOIN a ON u.conv_id = a.conv_id AND u.turn = a.turn"""

# ---- metrics ---------------------------------------------------------------------------------------------
ORACLES["test_summary"] = """
SELECT CAST(user_id AS VARCHAR) AS repo_id, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed,
       CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'passed' ELSE 'failed' END AS status
FROM events GROUP BY user_id"""

ORACLES["coverage"] = """
SELECT l_orderkey AS file, CAST(count(*) AS BIGINT) AS lines,
       CAST(count(*) FILTER (WHERE CAST(floor(l_quantity) AS BIGINT) % 3 > 0) AS BIGINT) AS covered,
       CAST((count(*) FILTER (WHERE CAST(floor(l_quantity) AS BIGINT) % 3 > 0)) * 10000 // count(*) AS BIGINT) AS coverage_bp
FROM lineitem GROUP BY l_orderkey"""

ORACLES["latency_quantiles"] = """
SELECT event_type AS operation, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99
FROM events GROUP BY event_type"""

ORACLES["latency_profile"] = """
SELECT event_type AS operation, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents,
       min(value) AS min_value, max(value) AS max_value,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) // count(*) AS BIGINT) AS mean_cents
FROM events GROUP BY event_type"""

# ---- reports ---------------------------------------------------------------------------------------------
ORACLES["markdown_report"] = f"""WITH {orders_findings_cte()},
r AS (SELECT CAST(c_custkey AS VARCHAR) AS repo_id FROM customer)
SELECT repo_id, CAST(0 AS BIGINT) AS pos, '# Code Review Report' || chr(10) || chr(10) AS text FROM r
UNION ALL
SELECT repo_id, CAST(1 AS BIGINT), 'No issues found.' FROM r WHERE repo_id NOT IN (SELECT repo_id FROM of)
UNION ALL
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY {_PRI}),
       '## ' || coalesce(title, 'Issue') || chr(10) || '- **Severity**: ' || coalesce(severity, 'Info') || chr(10)
       || '- **File**: ' || coalesce(file, 'N/A') || chr(10) || '- **Description**: ' || coalesce(description, '')
       || chr(10) || chr(10)
FROM of"""

ORACLES["json_report"] = f"""WITH {orders_findings_cte()},
r AS (SELECT CAST(c_custkey AS VARCHAR) AS repo_id FROM customer),
n AS (SELECT repo_id, count(*) AS n FROM of GROUP BY repo_id),
i AS (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY {_PRI}) AS pos,
             CAST(json_object('id', id, 'file', file, 'line', line, 'severity', severity, 'category', category,
                              'title', title, 'description', description, 'auto_fixable', auto_fixable) AS VARCHAR) AS obj
      FROM of)
SELECT repo_id, CAST(0 AS BIGINT) AS pos, '{{"findings": [' AS text FROM r
UNION ALL
SELECT i.repo_id, i.pos, i.obj || CASE WHEN i.pos < n.n THEN ',' ELSE '' END FROM i JOIN n ON i.repo_id = n.repo_id
UNION ALL
SELECT r.repo_id, CAST(coalesce(n.n, 0) + 1 AS BIGINT), '], "summary": "Analysis complete"}}' FROM r LEFT JOIN n ON r.repo_id = n.repo_id"""

ORACLES["bootstrap_report"] = f"""WITH {gen_findings_cte(['unsafe_call', 'missing_docstring'])},
o AS (SELECT *, CAST(list_position(['static','pattern','security','performance','testing','logic','policy'], stage) - 1 AS INTEGER)
             AS stage_order FROM gf)
SELECT DISTINCT repo_id, CAST(0 AS BIGINT) AS pos, '# Review Report' || chr(10) || chr(10) || '## Findings' || chr(10) AS text
FROM o
UNION ALL
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY stage_order, coalesce(line, 0), id),
       '### ' || title || ' (' || upper(severity) || ')' || chr(10) || '- **File**: ' || file || chr(10)
       || '- **Description**: ' || description || chr(10) || chr(10)
FROM o"""

ORACLES["full_phase_report"] = f"""WITH {orders_findings_cte()}
SELECT repo_id, CAST(0 AS BIGINT) AS pos,
       '# Full Review Report' || chr(10) || 'Date: 2024-01-31T00:00:00' || chr(10) || chr(10) || '## Summary'
       || chr(10) || '- Total Findings: ' || CAST(count(*) AS VARCHAR) || chr(10)
       || '- Critical: ' || CAST(count(*) FILTER (WHERE severity = 'critical') AS VARCHAR) || chr(10)
       || '- High: ' || CAST(count(*) FILTER (WHERE severity = 'high') AS VARCHAR) || chr(10)
       || '- Medium: ' || CAST(count(*) FILTER (WHERE severity = 'medium') AS VARCHAR) || chr(10)
       || '- Low: ' || CAST(count(*) FILTER (WHERE severity = 'low') AS VARCHAR) || chr(10) || chr(10)
       || '## Detailed Findings' || chr(10) AS text
FROM of GROUP BY repo_id
UNION ALL
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY severity, stage_order, seq, id),
       '### ' || title || ' [' || upper(severity) || ']' || chr(10) || '- File: ' || file || chr(10)
       || '- Description: ' || description || chr(10) || chr(10)
FROM of"""

# ---- streaming --------------------------------------------------------------------------------------------
ORACLES["run_progress"] = """
WITH re AS (SELECT CAST(user_id AS VARCHAR) AS run_id, ts, event_id, event_type, CAST(event_id % 3 AS INTEGER) AS d FROM events),
last AS (SELECT run_id, event_type FROM (
           SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn FROM re) WHERE rn = 1),
agg AS (SELECT run_id, CAST(sum(d) AS BIGINT) AS files_analyzed, CAST(count(*) AS BIGINT) AS n_events FROM re GROUP BY run_id)
SELECT a.run_id, l.event_type || '_complete' AS current_step, files_analyzed, n_events,
       upper(substr(l.event_type, 1, 1)) || substr(l.event_type, 2) || ' Complete' AS step_label
FROM agg a JOIN last l ON a.run_id = l.run_id"""
ORACLES["stream_progress"] = ORACLES["run_progress"]

ORACLES["stream_scores"] = f"""WITH {gen_findings_cte(ALL_KINDS)}
SELECT repo_id, CAST(count(*) AS BIGINT) AS n_findings,
       CAST(100 - sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5
                                    WHEN 'low' THEN 2 ELSE 0 END) AS INTEGER) AS score
FROM gf GROUP BY repo_id"""

# ---- languages --------------------------------------------------------------------------------------------
_LANG = """
lp AS (
  SELECT CAST(p_partkey % 50 AS VARCHAR) AS repo_id,
         ['.py', '.py', '.spec.py', '.test.js', '.java', '.ts', '.tsx', '.py', '.md', '.py'][CAST(p_size % 10 AS INTEGER) + 1] AS fname
  FROM part),
lc AS (
  SELECT repo_id, CASE regexp_extract(fname, '(\\.[^./]+)$', 1) WHEN '.py' THEN 'python' WHEN '.java' THEN 'java'
                       WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' ELSE 'other' END AS language
  FROM lp)"""

ORACLES["language_counts"] = f"""WITH {_LANG}
SELECT repo_id, language, CAST(count(*) AS BIGINT) AS n_files FROM lc GROUP BY repo_id, language"""

ORACLES["primary_language"] = f"""WITH {_LANG},
c AS (SELECT repo_id, language, CAST(count(*) AS BIGINT) AS n FROM lc WHERE language <> 'other' GROUP BY repo_id, language)
SELECT repo_id, arg_min(language, (-n, language)) AS primary_language, max(n) AS n_files FROM c GROUP BY repo_id"""

ORACLES["review_scores"] = scores_sql(
    f"""{gen_findings_cte(ALL_KINDS)}, {_LINT.strip()},
lf AS (
  SELECT repo_id, ['convention', 'refactor', 'warning', 'error'][CAST((k + j) % 4 AS INTEGER) + 1] AS severity FROM li),
{_CX.strip()},
cf AS (SELECT repo_id, 'high' AS severity FROM cx WHERE (s + j * 7) % 20 + 1 > 10),
allf AS (SELECT repo_id, severity FROM gf UNION ALL SELECT * FROM lf UNION ALL SELECT * FROM cf)""",
    "allf", repos_sql="SELECT DISTINCT CAST(p_partkey % 50 AS VARCHAR) AS repo_id FROM part")

ORACLES["node_counts"] = f"""WITH {GEN_PARAMS}
SELECT repo_id, file AS path, CASE WHEN v = 4 THEN 'error' ELSE 'success' END AS status,
       CAST(CASE v WHEN 0 THEN 4 + 8 * s WHEN 1 THEN 4 + s % 10 WHEN 2 THEN 4 + 8 * s WHEN 3 THEN 2 + 80 * s
                   WHEN 4 THEN NULL WHEN 5 THEN 10 WHEN 6 THEN 6 + 8 * s ELSE 5 + 3 * (s % 15) END AS INTEGER) AS node_count
FROM gp"""

ORACLES["diff_scope"] = f"""WITH {_FV}
SELECT b.repo_id, b.path, b.content
FROM {_snap(_D_TO)} b LEFT JOIN {_snap(_D_FROM)} a ON a.repo_id = b.repo_id AND a.path = b.path
WHERE a.content IS DISTINCT FROM b.content"""

ORACLES["n_plus_one"] = f"""
WITH n AS (
  SELECT CAST(o_custkey AS VARCHAR) AS repo_id, 'q/o' || CAST(o_orderkey AS VARCHAR) || '.py' AS file, 3 AS line,
         CAST(NULL AS INTEGER) AS "column", 'performance' AS category, 'Possible N+1 query' AS title,
         'Call ' || CASE o_orderstatus WHEN 'O' THEN 'db.execute' ELSE 'db.fetchone' END || ' inside a loop (depth 1)'
           AS description
  FROM orders WHERE o_orderstatus IN ('O', 'F'))
SELECT {finding_id_sql()} AS id, repo_id, file, line, title, description FROM n"""

# ---- shapes (see revline.sources.gen.gen_shape_files) --------------------------------------------------------
_SHAPES = """
sh AS (
  SELECT p_partkey AS k, p_size AS s, p_partkey % 6 AS v, translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij') AS w,
         CAST(p_partkey % 50 AS VARCHAR) AS repo_id, 'lib/s' || CAST(p_partkey AS VARCHAR) || '.py' AS path
  FROM part)"""

# A picker has one path, a loop, a condition, two operators, a comprehension and its filter.
ORACLES["decorator_facts"] = f"""WITH {_SHAPES}
SELECT repo_id, path, 'view_' || w AS name, 3 AS line, 4 AS end_line, 'cached|app.route(''/' || w || ''')' AS decorator_list, 1 AS complexity
FROM sh WHERE v = 0
UNION ALL
SELECT repo_id, path, 'pick_' || w, 1, 5, '', 7 FROM sh WHERE v = 3
UNION ALL
SELECT repo_id, path, 'm' || CAST(i AS VARCHAR), CAST(1 + 2 * i AS INTEGER), CAST(2 + 2 * i AS INTEGER), '', 1
FROM (SELECT *, unnest(range(1, s % 5 + 1)) AS i FROM sh WHERE v = 2)"""

ORACLES["method_facts"] = f"""WITH {_SHAPES}
SELECT repo_id, path, 'Box_' || w AS name, 1 AS line, CAST(4 + 2 * (s % 5) AS INTEGER) AS end_line,
       coalesce(array_to_string(list_transform(range(1, s % 5 + 1), lambda i: 'm' || CAST(i AS VARCHAR)), ','), '') AS method_list
FROM sh WHERE v = 2"""

ORACLES["import_kinds"] = f"""WITH {_SHAPES}
SELECT repo_id, path, unnest(['os', 'pandas', 'django.db', '', 'pkg_' || w, 'mod_' || w || '.sub']) AS module FROM sh WHERE v = 1"""

ORACLES["error_kinds"] = f"""WITH {_SHAPES}
SELECT repo_id, path, 'Syntax error at line ' || CASE s % 3 WHEN 1 THEN '3: expected an indented block after function definition on line 2'
         WHEN 0 THEN '2: ''('' was never closed' ELSE '2: unterminated string literal (detected at line 2)' END AS error,
       CASE s % 3 WHEN 1 THEN 3 ELSE 2 END AS error_line
FROM sh WHERE v = 5"""

ORACLES["magic_numbers"] = f"""WITH {_SHAPES},
m AS (
  SELECT repo_id, path AS file, 3 AS line, CAST(NULL AS INTEGER) AS "column", 'pattern' AS category, 'Magic Number' AS title,
         'Potential magic number detected' AS description
  FROM sh WHERE v = 4)
SELECT {finding_id_sql()} AS id, repo_id, file, line, title, description FROM m"""

ORACLES["frameworks"] = f"""WITH {_SHAPES}
SELECT DISTINCT repo_id, 'Django,pandas' AS frameworks FROM sh WHERE v = 1"""

ORACLES["missing_files"] = f"""WITH {_FV}
SELECT DISTINCT repo_id, path, 'Error reading file: ' || path AS error FROM fv
WHERE (repo_id, path) NOT IN (SELECT (repo_id, path) FROM {_snap(_D_FROM)})"""

ORACLES["coverage_by_repo"] = """
WITH l AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS repo_id, l_orderkey, l_linenumber % 3 AS line, max(CAST(floor(l_quantity) AS BIGINT) % 3) AS hits
  FROM lineitem GROUP BY ALL)
SELECT repo_id, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS lines,
       CAST(count(*) FILTER (WHERE hits > 0) AS BIGINT) AS covered,
       CAST(count(*) FILTER (WHERE hits > 0) * 10000 // count(*) AS BIGINT) AS coverage_bp
FROM l GROUP BY repo_id"""

ORACLES["run_state"] = """
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS key,
         CASE WHEN event_id % 5 > 0 THEN CAST(event_id AS VARCHAR) END AS value,
         count(*) OVER (PARTITION BY user_id, event_type) AS n_updates,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events)
SELECT run_id, key, value, CAST(n_updates AS BIGINT) AS n_updates FROM e WHERE rn = 1"""

# ---- B5/B6 on a commit graph ------------------------------------------------------------------------------
_DAG = """
k AS (
  SELECT o_orderkey AS k, o_orderstatus AS st, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 48 END AS step,
         CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE 'r' || CAST(o_orderkey % 48 AS VARCHAR) END AS repo_id FROM orders),
c AS (SELECT *, k // step AS i, (k // step) % 10 AS d, (k // step) // 10 AS ten FROM k),
e AS (
  SELECT repo_id, k, k - step * CASE WHEN d = 4 THEN CASE WHEN ten % 5 = 0 AND ten > 0 THEN 8 ELSE 2 END WHEN d = 7 THEN 4 ELSE 1 END AS p
  FROM c WHERE i > 0
  UNION ALL SELECT repo_id, k, k - step FROM c WHERE d = 7 AND ten % 4 <> 0),
pr AS (
  SELECT repo_id, max(k) AS b, max(k) - max(step) * (max(k // step) - max(k // step) // 2) AS a FROM c GROUP BY repo_id),
anc(repo_id, tip, k) AS (
  SELECT repo_id, unnest([a, b]), unnest([a, b]) FROM pr
  UNION SELECT e.repo_id, anc.tip, e.p FROM anc JOIN e ON e.k = anc.k),
base AS (
  SELECT x.repo_id, max(x.k) AS base FROM anc x JOIN anc y ON x.repo_id = y.repo_id AND x.k = y.k
  JOIN pr ON pr.repo_id = x.repo_id AND x.tip = a AND y.tip = b GROUP BY x.repo_id),
anc2(repo_id, tip, k) AS (
  SELECT repo_id, -1, base FROM base
  UNION SELECT e.repo_id, -1, e.p FROM anc2 JOIN e ON e.k = anc2.k),
tree AS (
  SELECT x.repo_id, tip, 'f' || CAST(k * 7 % 23 AS VARCHAR) || '.py' AS path, arg_max(k, k) AS k, arg_max(st, k) = 'P' AS gone
  FROM (SELECT * FROM anc UNION ALL SELECT * FROM anc2) x JOIN c USING (k) GROUP BY x.repo_id, tip, path),
live AS (SELECT *, 'v = ' || CAST(k % 1000 AS VARCHAR) AS content FROM tree WHERE NOT gone),
df AS (
  SELECT pr.repo_id, a, b, 2 AS dots, a AS from_tip FROM pr UNION ALL SELECT pr.repo_id, a, b, 3, -1 FROM pr)"""

ORACLES["dag_file_as_of"] = f"""WITH RECURSIVE {_DAG}
SELECT repo_id, 'c' || CAST(tip AS VARCHAR) AS "at", path, 'c' || CAST(k AS VARCHAR) AS commit, content FROM live WHERE tip >= 0"""

ORACLES["dag_changed_files"] = f"""WITH RECURSIVE {_DAG},
paths AS (SELECT DISTINCT df.repo_id, a, b, dots, from_tip, path FROM df JOIN live ON live.repo_id = df.repo_id AND live.tip IN (b, from_tip))
SELECT p.repo_id, 'c' || CAST(a AS VARCHAR) AS a, 'c' || CAST(b AS VARCHAR) AS b, p.path, dots,
       CASE WHEN x.content IS NULL THEN 'added' WHEN y.content IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
FROM paths p LEFT JOIN live x ON x.repo_id = p.repo_id AND x.tip = from_tip AND x.path = p.path
LEFT JOIN live y ON y.repo_id = p.repo_id AND y.tip = b AND y.path = p.path
WHERE x.content IS DISTINCT FROM y.content"""

# ---- D15 with weights ----------------------------------------------------------------------------------------
ORACLES["policy_weighted_topk"] = """
WITH dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
pt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
w AS (
  SELECT term, CAST(round(pow(ln(1 + CAST((SELECT count(DISTINCT item_id) FROM benchmark) AS DOUBLE) / count(*)), 2) * 1000000) AS BIGINT) AS w
  FROM pt GROUP BY term),
size AS (SELECT item_id, sqrt(CAST(sum(w) AS DOUBLE)) AS size FROM pt JOIN w USING (term) GROUP BY item_id),
sc AS (
  SELECT doc_id, item_id, CAST(floor(1000000 * CAST(sum(w) AS DOUBLE) / max(size)) AS BIGINT) AS score
  FROM dt JOIN pt USING (term) JOIN w USING (term) JOIN size USING (item_id) GROUP BY doc_id, item_id)
SELECT * FROM (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS INTEGER) AS rank, item_id, score FROM sc)
WHERE rank <= 3
"""

# ---- D8, D16 with rules in a table -----------------------------------------------------------------------------
ORACLES["rule_table_findings"] = ORACLES["rule_findings"].replace(
    "'Use of eval'))", """'Use of eval'),
  ('digits', '[0-9]{6}', 'info', 'CWE-2', 'Long number'),
  ('shout', '^[A-Z ]{8,}$', 'info', 'CWE-3', 'Line in capitals'))""") + """
UNION ALL
SELECT doc_id, line_no, 'passage-' || CAST(item_id AS VARCHAR), 'low', 'CWE-1', 'Passage ' || CAST(item_id AS VARCHAR)
FROM ln JOIN benchmark b ON contains(line, substr(b.text, 1, 24))"""

ORACLES["policy_table_violations"] = """
SELECT doc_id, 'passage-' || CAST(item_id AS VARCHAR) AS rule_id FROM documents d JOIN benchmark b ON contains(d.text, substr(b.text, 1, 24))
UNION ALL SELECT doc_id, 'digits' FROM documents WHERE regexp_matches(text, '[0-9]{6}')
UNION ALL SELECT doc_id, 'license-header' FROM documents WHERE NOT contains(text, 'License')"""

# ---- D9 with ordinary version strings ----------------------------------------------------------------------------
# A version as a number: epoch, a, b, then what follows the release (0 dev, 1 alpha, 3 rc, 4 nothing, 5 post) and its number.
_MIXED = """
rq AS (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN 'hot' ELSE 'pkg' || CAST(p_partkey % 40 AS VARCHAR) END AS name,
         'src/m' || CAST(p_partkey AS VARCHAR) || '.py' AS path, p_partkey % 10 AS f,
         CAST(p_size % 6 AS VARCHAR) || '.' || CAST(p_partkey % 9 AS VARCHAR) AS ab, (p_size % 6) * 10000 + (p_partkey % 9) * 100 AS n FROM part),
rv AS (
  SELECT *, CASE f WHEN 1 THEN 'v' || ab || '.0' WHEN 2 THEN ab || '.0.0' WHEN 3 THEN ab || 'rc1' WHEN 4 THEN ab || '.post2' WHEN 5 THEN ab || '.dev3'
            WHEN 6 THEN '1!' || ab WHEN 7 THEN ab || '-alpha.1' WHEN 8 THEN ab || '+local.5' WHEN 9 THEN 'latest-' || ab ELSE ab END AS version,
         CASE f WHEN 3 THEN n + 31 WHEN 4 THEN n + 52 WHEN 5 THEN n + 3 WHEN 6 THEN n + 10000040 WHEN 7 THEN n + 11 WHEN 9 THEN NULL ELSE n + 40 END AS v
  FROM rq),
ad AS (
  SELECT CASE WHEN p_partkey % 8 = 0 THEN 'hot' ELSE 'pkg' || CAST(p_partkey % 40 AS VARCHAR) END AS name,
         'ADV-' || CAST(p_partkey AS VARCHAR) AS advisory_id, p_partkey % 20 = 0 AS below, p_partkey % 20 <> 0 AND p_partkey % 200 = 4 AS unread,
         p_partkey % 28 = 0 AS above,
         (p_size % 6) * 10000 + (p_partkey % 7) * 100 + CASE WHEN p_partkey % 16 = 0 THEN 31 ELSE 40 END AS lo,
         ((p_size + p_partkey) % 7) * 10000 + (p_size % 9) * 100 + CASE WHEN p_partkey % 16 = 8 THEN 51 ELSE 40 END AS hi
  FROM part WHERE p_partkey % 4 = 0)"""

ORACLES["advisory_hits_mixed"] = f"""WITH {_MIXED}
SELECT path, rv.name, version, advisory_id, 'high' AS severity
FROM rv JOIN ad ON rv.name = ad.name AND NOT unread AND (below OR v >= lo) AND (above OR v < hi)
WHERE v IS NOT NULL"""

ORACLES["advisory_errors"] = f"""WITH {_MIXED}
SELECT 'requirement' AS kind, name, path AS item, version, 'Unreadable version: ' || version AS error FROM rv WHERE v IS NULL
UNION ALL SELECT 'advisory', name, advisory_id, 'any', 'Unreadable version: any' FROM ad WHERE unread"""

# ---- G4, E7 with state and event time ------------------------------------------------------------------------------
ORACLES["stream_severity_counts"] = f"""WITH {GEN_PARAMS},
old AS ({_gen_rows(["long_function", "too_many_parameters", "god_class", "magic_number", "complexity", "unsafe_call", "missing_docstring"])}),
live AS (
  SELECT repo_id, severity FROM old
  WHERE CAST(regexp_extract(file, 'm([0-9]+)', 1) AS BIGINT) % 4 <> 0 AND CAST(regexp_extract(file, 'm([0-9]+)', 1) AS BIGINT) % 6 <> 1
  UNION ALL SELECT repo_id, unnest(['high', 'low']) FROM gp WHERE k % 6 = 1),
d AS (SELECT DISTINCT repo_id, unnest(['critical', 'high', 'medium', 'low', 'info']) AS severity FROM gp)
SELECT d.repo_id, d.severity, count(live.severity) AS n
FROM d LEFT JOIN live ON live.repo_id = d.repo_id AND live.severity = d.severity GROUP BY d.repo_id, d.severity"""

ORACLES["stream_daily_counts"] = """
SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS repo_id,
       CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' ELSE 'info' END AS severity,
       count(*) AS n
FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT date_trunc('second', max(ts)) - INTERVAL 1 DAY FROM events)
GROUP BY ALL"""

# ---- D10 through calls -----------------------------------------------------------------------------------------
_WORD = "translate(CAST({} AS VARCHAR), '0123456789', 'abcdefghij')"
ORACLES["n_plus_one_calls"] = f"""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size % 5 AS d FROM part),
f AS (SELECT k, d, unnest(range(0, d + 1)) AS j FROM p),
e AS (
  SELECT k, j, k AS to_k, j + 1 AS to_j FROM f WHERE j < d
  UNION ALL SELECT f.k, f.j, p.k, 0 FROM f JOIN p ON p.k = f.k + 50 WHERE j = f.d AND f.k % 3 = 1
  UNION ALL SELECT k, j, k, 0 FROM f WHERE j = d AND k % 3 = 2),
r(k, j, n) AS (
  SELECT k, j, 0 FROM f WHERE j = d AND k % 3 = 0
  UNION SELECT e.k, e.j, r.n + 1 FROM r JOIN e ON e.to_k = r.k AND e.to_j = r.j WHERE r.n < 40),
best AS (SELECT k, j, min(n) AS n FROM r GROUP BY k, j)
SELECT CAST(e.k % 50 AS VARCHAR) AS repo_id, 'db/c' || CAST(e.k AS VARCHAR) || '.py' AS path, 3 AS line,
       'fn_' || {_WORD.format('to_k')} || '_' || CAST(to_j AS VARCHAR) AS call, CAST(n + 1 AS INTEGER) AS calls
FROM e JOIN best b ON b.k = to_k AND b.j = to_j WHERE e.j = 0"""

# ---- B10: where rules match --------------------------------------------------------------------------------------
ORACLES["rule_places"] = """
WITH p AS (
  SELECT CAST(p_partkey % 50 AS VARCHAR) AS repo_id, p_partkey % 3 AS l, p_size % 4 AS s,
         'x/l' || CAST(p_partkey AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.java' ELSE '.ts' END AS path FROM part),
m(lang, line_no, place, more) AS (VALUES
  (0, 2, 'comment', 0), (0, 3, 'string', 0), (0, 4, 'code', 0), (0, 6, 'string', 0), (0, 10, 'code', 1),
  (1, 2, 'comment', 0), (1, 3, 'string', 0), (1, 4, 'code', 0), (1, 6, 'comment', 0), (1, 10, 'code', 1),
  (2, 2, 'comment', 0), (2, 3, 'string', 0), (2, 4, 'code', 0), (2, 6, 'comment', 0), (2, 8, 'string', 0), (2, 9, 'code', 0), (2, 10, 'code', 1))
SELECT repo_id, path, line_no, 'eval-call' AS rule_id, place FROM p JOIN m ON m.lang = l AND (more = 0 OR s = 0)"""

# ---- A6: YAML files in a table -------------------------------------------------------------------------------------
ORACLES["config_from_yaml"] = f"""WITH {_CFG},
none AS (
  SELECT any_value(array_to_string(enabled_checks, ',')) AS enabled_checks FROM cfg WHERE CAST(repo_id AS BIGINT) % 3 = 0)
SELECT cfg.repo_id, CAST(repo_id AS BIGINT) % 10 = 7 AS failed,
       CASE WHEN CAST(repo_id AS BIGINT) % 10 = 7 THEN 'medium' ELSE severity_threshold END AS severity_threshold,
       CASE WHEN CAST(repo_id AS BIGINT) % 10 = 7 THEN none.enabled_checks ELSE array_to_string(cfg.enabled_checks, ',') END AS enabled_checks,
       CASE WHEN CAST(repo_id AS BIGINT) % 10 = 7 THEN TRUE ELSE auto_fix_enabled END AS auto_fix_enabled,
       CASE WHEN CAST(repo_id AS BIGINT) % 10 = 7 THEN TRUE ELSE auto_fix_safe_only END AS auto_fix_safe_only
FROM cfg, none"""
