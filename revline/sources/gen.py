"""Inputs derived from the driver tables that exercise every detector.

The driver tables hold no source code, so review queries run on files, reports, versions and
findings built from them with native functions. Each builder is a projection of one table, so
its size grows with the table; the oracle SQL recomputes the expected results from the same
parameters (never by parsing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revline.functions.ids import content_hash
from revline.schema import STAGES

NL = "\n"


def _seq_join(n: Column, fmt) -> Column:
    """Lines fmt(1..n) joined by newlines; empty when n <= 0 (sequence(1, 0) counts down)."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), fmt), NL)).otherwise(F.lit(""))


def _key_word(k: Column) -> Column:
    """The key in letters a to j: distinct, and free of anything a line rule looks for."""
    return F.translate(k.cast("string"), "0123456789", "abcdefghij")


def gen_source_files(part: DataFrame, repos: int = 50) -> DataFrame:
    """One Python file per part row, eight variants by ``p_partkey % 8``.

    v0 ``def f(a):`` + n lines ``    x = i``; v1 ``def f(p1..pm)`` with m = p_size % 10 params;
    v2 ``async def`` + n lines; v3 ``class C:`` + 10n lines; v4 a syntax error; v5 an
    ``os.system`` call; v6 a module docstring + ``def g`` with CRLF newlines; v7 p_size % 15
    nested ``if``. n = 2 * p_size. All but v4 end in a comment with the key, so no two texts are equal.
    """
    k, s = F.col("p_partkey"), F.col("p_size")
    n = s * 2
    v = k % 8
    m_params = s % 10
    m_ifs = s % 15
    y_lines = lambda cnt, sep=NL: F.array_join(F.array_repeat(F.lit("    y = 0"), cnt), sep)
    params = _seq_join(m_params, lambda i: F.concat(F.lit("p"), i.cast("string")))
    params = F.replace(params, F.lit(NL), F.lit(","))
    ifs = F.when(m_ifs > 0, F.concat(
        _seq_join(m_ifs, lambda j: F.concat(F.repeat(F.lit(" "), j * 4), F.lit("if a:"))), F.lit(NL)
    )).otherwise(F.lit(""))
    content = (
        F.when(v == 0, F.concat(F.lit("def f(a):\n"),
                                _seq_join(n, lambda i: F.concat(F.lit("    x = "), i.cast("string")))))
        .when(v == 1, F.concat(F.lit("def f("), params, F.lit("):\n    pass")))
        .when(v == 2, F.concat(F.lit("async def f(a):\n"), y_lines(n)))
        .when(v == 3, F.concat(F.lit("class C:\n"), y_lines(n * 10)))
        .when(v == 4, F.lit("def f(:"))
        .when(v == 5, F.lit("import os\nos.system('x')"))
        .when(v == 6, F.concat(F.lit('"""Module doc."""\r\ndef g(a):\r\n'), y_lines(n, "\r\n")))
        .otherwise(F.concat(F.lit("def f(a):\n"), ifs, F.repeat(F.lit(" "), (m_ifs + 1) * 4), F.lit("pass")))
    )
    content = F.when(v == 4, content).otherwise(F.concat(content, F.lit("  # "), _key_word(k)))
    return part.select(
        (k % repos).cast("string").alias("repo_id"),
        F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py")).alias("path"),
        content.alias("content"),
    )


# --- fixed values: severity of generated findings by event type and by order priority ---
EVENT_SEVERITY = {"error": "critical", "purchase": "high", "click": "medium", "view": "low",
                  "signup": "info"}
ORDER_SEVERITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low",
                  "4-NOT SPECIFIED": "info"}
# Category emitted by each stage.
STAGE_CATEGORY = {"static": "style", "pattern": "pattern", "security": "security",
                  "performance": "performance", "testing": "testing", "logic": "logic",
                  "policy": "policy"}
# -----------------------------------------------------------------------------------------


def _map_col(mapping: dict, c: Column, default=None) -> Column:
    expr = None
    for key, val in mapping.items():
        expr = F.when(c == key, F.lit(val)) if expr is None else expr.when(c == key, F.lit(val))
    return expr.otherwise(F.lit(default))


def _stage_cols(idx: Column):
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (idx % len(STAGES)).cast("int") + 1)
    category = _map_col(STAGE_CATEGORY, stage)
    return stage, category, (idx % len(STAGES)).cast("int")


def _finish(df: DataFrame) -> DataFrame:
    cols = ["repo_id", "file", "line", "column", "category", "title", "description"]
    return df.withColumn("id", content_hash(*cols))


def gen_findings_events(events: DataFrame) -> DataFrame:
    """Findings from events: repo = (user, hour), severity by event type, stage by event id."""
    stage, category, stage_order = _stage_cols(F.col("event_id"))
    df = events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMddHH")).alias("repo_id"),
        F.concat(F.lit("events/"), F.col("event_type"), F.lit(".py")).alias("file"),
        (F.col("event_id") % 1000).cast("int").alias("line"),
        F.lit(None).cast("int").alias("column"),
        _map_col(EVENT_SEVERITY, F.col("event_type")).alias("severity"),
        category.alias("category"),
        F.concat(F.lit("Event "), F.col("event_type")).alias("title"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("description"),
        (F.col("value") > 50).alias("auto_fixable"),
        stage.alias("stage"),
        stage_order.alias("stage_order"),
        F.col("event_id").cast("long").alias("seq"),
    )
    return _finish(df)


def gen_findings_orders(orders: DataFrame) -> DataFrame:
    """Findings from orders: repo = customer, severity by priority, insertion order by date.

    Every ninth order gets a title with a newline and a stray ``)`` so that its fix candidate
    does not parse (the negative case of the fix check).
    """
    stage, category, stage_order = _stage_cols(F.col("o_orderkey"))
    title = F.concat(F.lit("Priority "), F.col("o_orderpriority"),
                     F.when(F.col("o_orderkey") % 9 == 0, F.lit("\n)")).otherwise(F.lit("")))
    df = orders.select(
        F.col("o_custkey").cast("string").alias("repo_id"),
        F.concat(F.lit("orders/"), F.col("o_orderstatus"), F.lit(".py")).alias("file"),
        F.dayofmonth("o_orderdate").cast("int").alias("line"),
        F.lit(None).cast("int").alias("column"),
        _map_col(ORDER_SEVERITY, F.col("o_orderpriority")).alias("severity"),
        category.alias("category"),
        title.alias("title"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"),
        (F.col("o_orderstatus") != "P").alias("auto_fixable"),
        stage.alias("stage"),
        stage_order.alias("stage_order"),
        # insertion order: order date (days since epoch, no time-zone dependence), then key
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 10_000_000_000
         + F.col("o_orderkey")).alias("seq"),
    )
    return _finish(df)


def gen_file_versions(orders: DataFrame) -> DataFrame:
    """File versions: repo = customer, path by order key, commit = order date (linear history).

    commit_seq is the order date as days since epoch; a status 'P' order deletes the file.
    """
    return orders.select(
        F.col("o_custkey").cast("string").alias("repo_id"),
        F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".py")).alias("path"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("commit_seq"),
        F.col("o_orderkey").alias("version_id"),
        F.concat(F.lit("v = "), F.col("o_orderkey").cast("string")).alias("content"),
        (F.col("o_orderstatus") == "P").alias("is_deleted"),
    )


def gen_passage_rules(benchmark: DataFrame) -> DataFrame:
    """A rule (for lines and, as must_not_match, for whole texts) for the first 24 characters of each benchmark item."""
    start = F.substring("text", 1, 24)
    regex = F.concat(F.lit("\\Q"), start, F.lit("\\E"))
    return benchmark.select(F.concat(F.lit("passage-"), F.col("item_id").cast("string")).alias("rule_id"), regex.alias("regex"),
                            start.alias("literal"), F.lit("low").alias("severity"), F.lit("CWE-1").alias("cwe_id"),
                            F.concat(F.lit("Passage "), F.col("item_id").cast("string")).alias("title"))


def gen_commits(orders: DataFrame) -> DataFrame:
    """A commit graph: one commit per order; every third belongs to one hot repository, the others to 32 more.

    By the place i of a commit in its repository: commits 4 to 6 of ten are a branch off commit 2 (in every fifth ten
    off the branch before), 7 goes on from 3 and merges 6 (but in every fourth ten), the others go on from the last.
    """
    k = F.col("o_orderkey")
    step = F.when(k % 3 == 0, 3).otherwise(48)
    rows = orders.select(
        F.when(k % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), (k % 48).cast("string"))).alias("repo_id"), k.alias("k"),
        step.cast("long").alias("step"), F.floor(k / step).cast("long").alias("i"))
    d, ten = F.col("i") % 10, F.expr("i div 10")
    back = F.when(d == 4, F.when((ten % 5 == 0) & (ten > 0), 8).otherwise(2)).when(d == 7, 4).otherwise(1)
    parents = F.array(F.struct(F.lit(0).alias("no"), F.when(F.col("i") > 0, F.col("k") - F.col("step") * back).alias("p")),
                      F.struct(F.lit(1).alias("no"), F.when((d == 7) & (ten % 4 != 0), F.col("k") - F.col("step")).alias("p")))
    wanted = F.filter(parents, lambda x: (x["no"] == 0) | x["p"].isNotNull())
    return rows.select("repo_id", "k", "i", F.explode(wanted).alias("e")).select(
        "repo_id", F.concat(F.lit("c"), F.col("k").cast("string")).alias("commit"),
        F.concat(F.lit("c"), F.col("e.p").cast("string")).alias("parent"), F.col("e.no").alias("parent_no"), F.col("i").alias("seq"))


def gen_commit_versions(orders: DataFrame) -> DataFrame:
    """The file each commit of ``gen_commits`` writes; a status 'P' order deletes it."""
    k = F.col("o_orderkey")
    return orders.select(
        F.when(k % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), (k % 48).cast("string"))).alias("repo_id"),
        F.concat(F.lit("f"), (k * 7 % 23).cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.lit("c"), k.cast("string")).alias("commit"),
        F.concat(F.lit("v = "), (k % 1000).cast("string")).alias("content"),
        (F.col("o_orderstatus") == "P").alias("is_deleted"))


def gen_commit_pairs(orders: DataFrame) -> DataFrame:
    """For each repository of ``gen_commits`` the commits at the middle (a) and at the end (b) of its numbering."""
    k = F.col("o_orderkey")
    repo = F.when(k % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), (k % 48).cast("string")))
    last = orders.groupBy(repo.alias("repo_id")).agg(F.max("o_orderkey").alias("k")) \
        .withColumn("step", F.when(F.col("repo_id") == "hot", 3).otherwise(48))
    middle = F.expr("k - step * ((k div step) - (k div step) div 2)")
    return last.select("repo_id", F.concat(F.lit("c"), middle.cast("string")).alias("a"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("b"))


def gen_secret_text(documents: DataFrame) -> DataFrame:
    """Documents with an ``sk-`` token (32 hex) and a ``key=`` value of 18 to 21 characters."""
    md = F.md5(F.col("doc_id").cast("string"))
    key_tail = F.substring(F.md5((F.col("doc_id") + 1).cast("string")), 1, 18 + (F.col("doc_id") % 4).cast("int"))
    return documents.select(
        "doc_id",
        F.concat(F.col("text"), F.lit(" sk-"), md, F.lit(" key="), key_tail).alias("text"),
    )


def gen_scope_paths(part: DataFrame, repos: int = 50) -> DataFrame:
    """Paths in assorted folders and extensions, for the scope filters."""
    # fixed folder list: plain, excluded by the bootstrap list, by the full list and by globs
    dirs = ["src", "src/node_modules/lib", ".github/workflows", "pkg/.git/hooks", "vendor/x",
            "tests", "logs/old", ".cache/a", "src/.gemini", "lib/util"]
    exts = [".py", ".py", ".spec.py", ".test.js", ".java", ".ts", ".tsx", ".py", ".md", ".py"]
    k = F.col("p_partkey")
    d = F.element_at(F.array(*[F.lit(x) for x in dirs]), (k % len(dirs)).cast("int") + 1)
    e = F.element_at(F.array(*[F.lit(x) for x in exts]), (F.col("p_size") % len(exts)).cast("int") + 1)
    return part.select(
        (k % repos).cast("string").alias("repo_id"),
        F.concat(d, F.lit("/m"), k.cast("string"), e).alias("path"),
    )


def gen_lint_reports(part: DataFrame) -> DataFrame:
    """Raw linter JSON per file: ``p_partkey % 4`` issues; every tenth file a failure object."""
    # fixed list of linter message types (the linter's own severities)
    types = F.array(*[F.lit(t) for t in ["convention", "refactor", "warning", "error"]])
    k = F.col("p_partkey")
    path = F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py"))
    issues = F.transform(
        F.when(k % 4 > 0, F.sequence(F.lit(1), (k % 4).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda j: F.struct(
            path.alias("path"), j.alias("line"), (j - 1).alias("column"),
            F.element_at(types, ((k + j) % 4).cast("int") + 1).alias("type"),
            F.concat(F.lit("message "), j.cast("string")).alias("message"),
            F.concat(F.lit("C0"), j.cast("string")).alias("message-id"),
            F.concat(F.lit("symbol-"), j.cast("string")).alias("symbol"),
        ))
    report = F.when(k % 10 == 0, F.lit('{"error": "Pylint timeout"}')).otherwise(F.to_json(issues))
    return part.select((k % 50).cast("string").alias("repo_id"), path.alias("path"), report.alias("report"))


def gen_complexity_reports(part: DataFrame) -> DataFrame:
    """Raw complexity JSON per file: a map of path to blocks; ``p_partkey % 3 + 1`` blocks for
    this file, an extra entry for another file when ``p_partkey % 4 = 1``, and a failure object
    for this file when ``p_partkey % 10 = 0``."""
    k, s = F.col("p_partkey"), F.col("p_size")
    path = F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py"))
    blocks = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda j: F.struct(
        F.concat(F.lit("fn"), j.cast("string")).alias("name"),
        (j * 10 + 1).alias("lineno"),
        ((s + j * 7) % 20 + 1).alias("complexity"),
        F.lit("F").alias("type"),
    ))
    this_entry = F.when(k % 10 == 0, F.lit('{"error": "could not parse"}')).otherwise(F.to_json(blocks))
    other = F.lit('[{"name": "other", "lineno": 1, "complexity": 30, "type": "F"}]')
    report = F.concat(
        F.lit('{"'), path, F.lit('": '), this_entry,
        F.when(k % 4 == 1, F.concat(F.lit(', "vendor/other.py": '), other)).otherwise(F.lit("")),
        F.lit("}"))
    return part.select((k % 50).cast("string").alias("repo_id"), path.alias("path"), report.alias("report"))


def gen_requirements(part: DataFrame) -> DataFrame:
    """Pinned packages: name from the brand, version ``a.b.c`` from size and key."""
    return part.select(
        F.concat(F.lit("pkg"), F.regexp_extract("p_brand", r"(\d+)", 1)).alias("name"),
        F.concat_ws(".", (F.col("p_size") % 5).cast("string"), (F.col("p_partkey") % 10).cast("string"),
                    (F.col("p_size") % 7).cast("string")).alias("version"),
        F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"),
    )


def gen_advisories(part: DataFrame) -> DataFrame:
    """Two advisories per package (brand): versions in [b%5.0.0, b%5.5.0) and [3.b%10.0, 4.0.0)."""
    b = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    brands = part.select(b.alias("b")).distinct()
    name = F.concat(F.lit("pkg"), F.col("b").cast("string"))
    one = brands.select(name.alias("name"), F.concat(F.lit("ADV-"), F.col("b").cast("string"), F.lit("-1")).alias("advisory_id"),
                        F.concat_ws(".", (F.col("b") % 5).cast("string"), F.lit("0"), F.lit("0")).alias("lo"),
                        F.concat_ws(".", (F.col("b") % 5).cast("string"), F.lit("5"), F.lit("0")).alias("hi"),
                        F.lit("high").alias("severity"))
    two = brands.select(name.alias("name"), F.concat(F.lit("ADV-"), F.col("b").cast("string"), F.lit("-2")).alias("advisory_id"),
                        F.concat_ws(".", F.lit("3"), (F.col("b") % 10).cast("string"), F.lit("0")).alias("lo"),
                        F.lit("4.0.0").alias("hi"),
                        F.lit("critical").alias("severity"))
    return one.unionByName(two)


def gen_mixed_requirements(part: DataFrame) -> DataFrame:
    """Pinned packages with version strings of many forms; a third of them name one hot package.

    ``a.b`` with a = p_size % 6, b = p_partkey % 9, written by p_partkey % 10 as: a.b, va.b.0, a.b.0.0, a.brc1, a.b.post2,
    a.b.dev3, 1!a.b, a.b-alpha.1, a.b+local.5, or no version at all.
    """
    k = F.col("p_partkey")
    ab = F.concat((F.col("p_size") % 6).cast("string"), F.lit("."), (k % 9).cast("string"))
    forms = [ab, F.concat(F.lit("v"), ab, F.lit(".0")), F.concat(ab, F.lit(".0.0")), F.concat(ab, F.lit("rc1")), F.concat(ab, F.lit(".post2")),
             F.concat(ab, F.lit(".dev3")), F.concat(F.lit("1!"), ab), F.concat(ab, F.lit("-alpha.1")), F.concat(ab, F.lit("+local.5")),
             F.concat(F.lit("latest-"), ab)]
    name = F.when(k % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("pkg"), (k % 40).cast("string")))
    return part.select(name.alias("name"), F.element_at(F.array(*forms), (k % 10).cast("int") + 1).alias("version"),
                       F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py")).alias("path"))


def gen_mixed_advisories(part: DataFrame) -> DataFrame:
    """One advisory for every fourth part: from a.b to c.d, open below or above for some, one bound in 50 unreadable."""
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 8 == 0, F.lit("hot")).otherwise(F.concat(F.lit("pkg"), (k % 40).cast("string")))
    lo = F.concat((s % 6).cast("string"), F.lit("."), (k % 7).cast("string"), F.when(k % 16 == 0, "rc1").when(k % 16 == 4, ".0").otherwise(""))
    hi = F.concat(((s + k) % 7).cast("string"), F.lit("."), (s % 9).cast("string"), F.when(k % 16 == 8, ".post1").otherwise(""))
    return part.where(k % 4 == 0).select(
        name.alias("name"), F.concat(F.lit("ADV-"), k.cast("string")).alias("advisory_id"),
        F.when(k % 20 == 0, F.lit(None)).when(k % 200 == 4, F.lit("any")).otherwise(lo).alias("lo"),
        F.when(k % 28 == 0, F.lit(None)).otherwise(hi).alias("hi"), F.lit("high").alias("severity"))


def gen_review_events(events: DataFrame) -> DataFrame:
    """A review run's event stream: run = user, node = event type, step label and counters."""
    return events.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id"),
        F.col("event_type").alias("node"),
        F.concat(F.col("event_type"), F.lit("_complete")).alias("current_step"),
        (F.col("event_id") % 3).cast("int").alias("files_delta"),
    )


# fixed value: severity threshold chosen per market segment in generated configs
SEGMENT_THRESHOLD = {"AUTOMOBILE": "high", "BUILDING": "low", "FURNITURE": "critical",
                     "MACHINERY": "info", "HOUSEHOLD": "medium"}


def gen_repo_configs(customer: DataFrame) -> DataFrame:
    """One user config document (JSON) per customer-repo.

    key % 3 = 0: none (defaults); 1: a threshold by segment and an ``auto_fix`` without
    ``safe_only``; 2: two enabled checks, skip ``style``, and for HOUSEHOLD an explicitly empty
    threshold.
    """
    k = F.col("c_custkey")
    thr = _map_col(SEGMENT_THRESHOLD, F.col("c_mktsegment"))
    one = F.format_string('{"severity_threshold": "%s", "auto_fix": {"enabled": %s}}', thr,
                          F.when(F.col("c_acctbal") > 0, F.lit("true")).otherwise(F.lit("false")))
    two = F.concat(
        F.lit('{"enabled_checks": ["security_audit", "performance_analysis"], "skip_categories": ["style"]'),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(', "severity_threshold": null')).otherwise(F.lit("")),
        F.lit("}"))
    doc = F.when(k % 3 == 1, one).when(k % 3 == 2, two)
    return customer.select(k.cast("string").alias("repo_id"), doc.alias("config_json"))


def gen_test_results(events: DataFrame) -> DataFrame:
    """Test outcomes: repo = user, one test per event, an error event is a failed test."""
    return events.select(F.col("user_id").cast("string").alias("repo_id"),
                         F.concat(F.lit("test_"), F.col("event_id").cast("string")).alias("test"),
                         F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("passed")).alias("outcome"))


def gen_line_hits(lineitem: DataFrame) -> DataFrame:
    """Coverage hits: file = order, line = line number, hits = floor(quantity) % 3."""
    return lineitem.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"),
                           (F.floor("l_quantity") % 3).alias("hits"))


def gen_runs(events: DataFrame) -> DataFrame:
    """A run log: operation = event type, value = the event's measured value."""
    return events.select(F.col("event_type").alias("operation"), "value")


def doc_files(documents: DataFrame) -> DataFrame:
    """Documents as files: path ``docs/<id>.txt``, persona by language (es has none: fallback)."""
    persona = F.when(F.col("lang") == "en", F.lit("architect")).when(F.col("lang") == "de", F.lit("mentor")) \
        .when(F.col("lang") == "fr", F.lit("security")).otherwise(F.lit("reviewer"))
    return documents.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
                            F.col("text").alias("content"), persona.alias("persona_id"))


def gen_loop_files(orders: DataFrame) -> DataFrame:
    """Data-access files, one per order, by status: 'O' queries inside a ``for`` loop, 'F' fetches
    inside a comprehension, 'P' makes one batched call (no N+1)."""
    body = (F.when(F.col("o_orderstatus") == "O",
                   F.lit("def load(db, rows):\n    for r in rows:\n        db.execute(r)\n    return rows\n"))
            .when(F.col("o_orderstatus") == "F",
                  F.lit("def load(db, rows):\n    db.execute(rows)\n    return [db.fetchone() for _ in rows]\n"))
            .otherwise(F.lit("def load(db, rows):\n    return db.executemany(rows)\n")))
    return orders.select(F.col("o_custkey").cast("string").alias("repo_id"),
                         F.concat(F.lit("q/o"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"),
                         F.concat(body, F.lit("# "), _key_word(F.col("o_orderkey")), F.lit(NL)).alias("content"))


def gen_shape_files(part: DataFrame, repos: int = 50) -> DataFrame:
    """One Python file per part row with the key in its text, six shapes by ``p_partkey % 6``.

    0 a decorated function; 1 aliased, from- and relative imports; 2 a class with p_size % 5 methods and an
    ``async`` one; 3 a loop, a condition with ``and`` / ``or`` and a comprehension; 4 one of the magic numbers
    on its third line; 5 one of three syntax errors.
    """
    k, s = F.col("p_partkey"), F.col("p_size")
    word = _key_word(k)
    shape = k % 6
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    methods = _seq_join(s % 5, lambda i: text("    def m", i.cast("string"), "(self):\n        return self"))
    number = F.element_at(F.array(*[F.lit(x) for x in ("100", "1000", "3600", "86400")]), (s % 4).cast("int") + 1)
    broken = F.element_at(F.array(*[F.lit(x) for x in ("x = (", "def f():\nreturn x", "x = 'open")]), (s % 3).cast("int") + 1)
    content = (
        F.when(shape == 0, text("@cached\n@app.route('/", word, "')\ndef view_", word, "(a):\n    return a"))
        .when(shape == 1, text("import os as o, pandas\nfrom django.db import models as m\nfrom . import near\nfrom .pkg_", word,
                               " import x\nimport mod_", word, ".sub"))
        .when(shape == 2, text("class Box_", word, ":\n    size = 1\n", methods, F.when(s % 5 > 0, F.lit(NL)).otherwise(F.lit("")),
                               "    async def later(self):\n        return self"))
        .when(shape == 3, text("def pick_", word, "(a, b):\n    for x in a:\n        if x and b or a:\n            pass\n"
                                                  "    return [y for y in b if y]"))
        .when(shape == 4, text("name = '", word, "'\nsize = 7\nlimit = ", number))
        .otherwise(text("# ", word, NL, broken))
    )
    return part.select((k % repos).cast("string").alias("repo_id"),
                       F.concat(F.lit("lib/s"), k.cast("string"), F.lit(".py")).alias("path"), content.alias("content"))


def gen_pushes(part: DataFrame) -> list[DataFrame]:
    """Three pushes of the files of ``gen_source_files``: all; every fourth emptied; those with key % 6 = 1 rewritten."""
    files = gen_source_files(part.select("*"))
    key = F.regexp_extract("path", "m([0-9]+)", 1).cast("long")
    push = lambda df, n: df.withColumn("version", F.lit(n).cast("long"))
    return [push(files, 1), push(files.where(key % 4 == 0).withColumn("content", F.lit("")), 2),
            push(files.where(key % 6 == 1).withColumn("content", F.concat(F.lit("import os\nos.system('x')  # "), _key_word(key))), 3)]


def gen_event_stream(events: DataFrame) -> DataFrame:
    """Findings with an event time; every fifth event comes twice. The time does not depend on the session's zone."""
    at = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 \
        + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    twice = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return events.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("repo_id"),
                         _map_col(EVENT_SEVERITY, F.col("event_type")).alias("severity"), F.timestamp_seconds(at).alias("ts"),
                         F.explode(twice).alias("_n")).drop("_n")


def gen_call_files(part: DataFrame, repos: int = 50) -> DataFrame:
    """A chain of p_size % 5 + 1 functions a file: the first loops over the second (or over a query), the last, by
    p_partkey % 3, makes a query, calls the first of the file 50 keys on, or calls its own first function."""
    k, d = F.col("p_partkey"), F.col("p_size") % 5
    name = lambda key, j: F.concat(F.lit("fn_"), _key_word(key), F.lit("_"), j.cast("string"))
    last = F.when(k % 3 == 0, F.lit("db.execute(r)")).when(k % 3 == 1, F.concat(name(k + repos, F.lit(0)), F.lit("(db, r)"))) \
        .otherwise(F.concat(name(k, F.lit(0)), F.lit("(db, r)")))
    step = lambda j: F.when(j < d, F.concat(name(k, j + 1), F.lit("(db, r)"))).otherwise(last)
    chain = F.array_join(F.transform(F.sequence(F.lit(0), d), lambda j: F.concat(
        F.lit("def "), name(k, j), F.lit("(db, r):\n"), F.when(j == 0, F.lit("    for x in r:\n    ")).otherwise(F.lit("")), F.lit("    "), step(j))), NL)
    return part.select((k % repos).cast("string").alias("repo_id"), F.concat(F.lit("db/c"), k.cast("string"), F.lit(".py")).alias("path"), chain.alias("content"))


def gen_place_files(part: DataFrame, repos: int = 50) -> DataFrame:
    """One .py, .java or .ts file per part row (p_partkey % 3) with calls of eval in comments, strings and code.

    Line 2 a comment, 3 a string, 4 code; line 6 inside a text block (.py) or a block comment; .ts: 8 in a template
    string, 9 in its hole; p_size % 4 = 0: one more in code on line 10, after a string with an escaped quote.
    """
    k = F.col("p_partkey")
    last = F.when(F.col("p_size") % 4 == 0, F.lit('\nt = "a\\"b" + eval(7)')).otherwise(F.lit(""))
    word = _key_word(k)
    py = F.concat(F.lit("w = '"), word, F.lit("'\n# eval(1) \"\nx = \"eval(2) # not\"\ny = eval(3)\n'''\neval(4)\n'''\nz = 1\nu = 2"), last)
    java = F.concat(F.lit('w = "'), word, F.lit("\";\n// eval(1) \"\nx = \"eval(2) // not\";\ny = eval(3);\n/* open\neval(4) ' */\nz = '\"';\nu = 1;\nv = 2;"), last)
    ts = F.concat(F.lit("w = '"), word, F.lit("';\n// eval(1) `\nx = 'eval(2) // not';\ny = eval(3);\n/* open\neval(4) ` */\nz = `a\n"
                                              "eval(5) ${ {b: `\n`} && eval(6)}`;"), last)
    return part.select((k % repos).cast("string").alias("repo_id"),
                       F.concat(F.lit("x/l"), k.cast("string"), F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".java").otherwise(".ts")).alias("path"),
                       F.when(k % 3 == 0, py).when(k % 3 == 1, java).otherwise(ts).alias("content"))


def gen_yaml_configs(customer: DataFrame) -> DataFrame:
    """The documents of ``gen_repo_configs`` as YAML files (block style for thresholds), every tenth one broken."""
    k = F.col("repo_id").cast("long")
    block = F.regexp_replace("config_json", r'^\{"severity_threshold": "(\w+)", "auto_fix": \{"enabled": (\w+)\}\}$',
                             "# own settings\nseverity_threshold: $1\nauto_fix:\n  enabled: $2\n")
    return gen_repo_configs(customer).select("repo_id", F.when(k % 10 == 7, F.lit("a: [1")).otherwise(block).alias("config_yaml"))
