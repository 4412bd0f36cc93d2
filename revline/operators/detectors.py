"""Facts and text → findings.

Line scans and substring checks run natively *before* the parse step and are carried through
it as small columns; the parse output then feeds every detector at once. Each detector yields an
array of finding structs per file; the arrays are concatenated and exploded once, so one parse
serves all detectors without caching or a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revline.functions.ids import finding_id
from revline.functions.text import normalize_newlines, split_lines
from revline.operators.facts import FACT_FIELDS, parse_files
from revline.operators.languages import known_files
from revline.schema import FINDING_COLUMNS, STAGE_ORDER

# --- fixed values: smell thresholds (strict >), magic numbers and messages -------------------
LONG_FUNCTION_LINES = 50
MAX_PARAMETERS = 5
GOD_CLASS_LINES = 500
COMPLEXITY_LIMIT = 10
MAGIC_NUMBERS = ["1000", "100", "86400", "3600"]
MAGIC_MESSAGE = "Potential magic number detected"
UNSAFE_CALL_MARKERS = ("import os", "os.system")
UNSAFE_TITLE = "Unsafe system call"
UNSAFE_DESCRIPTION = "Possible shell injection vulnerability using os.system"
DOCSTRING_MARKERS = ('"""', "'''")
DOCSTRING_MIN_CHARS = 10
DOCSTRING_TITLE = "Missing docstring"
DOCSTRING_DESCRIPTION = "File or function is missing a docstring."
COMPLEXITY_TITLE = "High Cyclomatic Complexity"
COMPLEXITY_MESSAGE = "Function %s has complexity %d"
LONG_FUNCTION_MESSAGE = "Function '%s' is %d lines long (>50)"
TOO_MANY_PARAMETERS_MESSAGE = "Function '%s' has %d parameters (>5)"
GOD_CLASS_MESSAGE = "Class '%s' is %d lines long (>500)"
# Smell titles: the smell type with underscores as spaces, title case.
SMELL_TITLES = {"long_function": "Long Function", "too_many_parameters": "Too Many Parameters",
                "god_class": "God Class", "magic_number": "Magic Number"}
# Query verbs for the N+1 rule (calls inside loops).
QUERY_VERBS = ["execute", "executemany", "query", "raw", "fetchone", "fetchall", "fetchmany",
               "filter", "filter_by"]
# ---------------------------------------------------------------------------------------------

# ``1000`` contains ``100``, so the alternation below finds every line the list finds.
MAGIC_REGEX = "|".join(sorted(set(MAGIC_NUMBERS), key=len))

SMELL_DETECTORS = ["long_function", "too_many_parameters", "god_class", "magic_number"]
ALL_DETECTORS = SMELL_DETECTORS + ["complexity", "unsafe_call", "missing_docstring"]
PARSE_DETECTORS = set(SMELL_DETECTORS) | {"complexity"}


def prepare_files(files: DataFrame) -> DataFrame:
    """Native pre-pass: normalised text, line count and the line/substring flags."""
    content = normalize_newlines("content")
    df = files.withColumn("content", content)
    lines = split_lines("content")
    magic_lines = F.when(
        F.col("content").rlike(MAGIC_REGEX),
        F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(MAGIC_REGEX), i + 1)), lambda x: x.isNotNull()),
    ).otherwise(F.array().cast("array<int>"))
    return df.select(
        "repo_id", "path", "content",
        F.size(lines).alias("total_lines"),
        magic_lines.alias("magic_lines"),
        (F.col("content").contains(UNSAFE_CALL_MARKERS[0]) & F.col("content").contains(UNSAFE_CALL_MARKERS[1]))
        .alias("unsafe_call"),
        (~F.col("content").contains(DOCSTRING_MARKERS[0]) & ~F.col("content").contains(DOCSTRING_MARKERS[1])
         & (F.length("content") > DOCSTRING_MIN_CHARS)).alias("missing_docstring"),
    )


CARRY = ["repo_id", "path", "total_lines", "magic_lines", "unsafe_call", "missing_docstring"]


def file_facts(files: DataFrame, partitions: int | None = None, dedup_content: bool = False) -> DataFrame:
    """``source_files(repo_id, path, content)`` → one facts row per file (no content).

    The parse runs in place, straight from the scan: one read, no shuffle of contents. Facts depend on the
    content only, so a worker remembers those of recent contents (bounded by bytes). ``dedup_content`` instead
    parses each distinct content once for the whole corpus, at the price of shuffling the contents and a join
    back; it pays where a table holds few distinct texts.
    """
    prepared = prepare_files(files)
    if not dedup_content or files.isStreaming:
        return parse_files(prepared, carry=CARRY, partitions=partitions)
    spark = files.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # null content (undecodable file) gets its own key so it still comes back as an error row
    keyed = prepared.withColumn("content_hash", F.coalesce(F.sha2(F.col("content"), 256), F.lit("null")))
    distinct = keyed.groupBy("content_hash").agg(F.any_value("content").alias("content")) \
        .repartition(n, "content_hash")
    parsed = parse_files(distinct, carry=["content_hash"], partitions=0)
    facts = keyed.drop("content").join(parsed, "content_hash")
    return facts.select(*CARRY, *[f.name for f in FACT_FIELDS])


def _f(line, severity, stage, category, title, description, fixable) -> Column:
    return F.struct(
        F.lit(None).cast("int").alias("line") if line is None else line.cast("int").alias("line"),
        F.lit(severity).alias("severity"),
        F.lit(stage).alias("stage"),
        F.lit(category).alias("category"),
        title.alias("title") if isinstance(title, Column) else F.lit(title).alias("title"),
        description.alias("description") if isinstance(description, Column) else F.lit(description).alias("description"),
        F.lit(fixable).alias("auto_fixable"),
    )


def _empty() -> Column:
    return F.array().cast(
        "array<struct<line:int,severity:string,stage:string,category:string,title:string,"
        "description:string,auto_fixable:boolean>>")


def _smell(title: str) -> dict:
    return dict(severity="medium", stage="pattern", category="pattern", title=title, fixable=True)


def _detector_array(name: str) -> Column:
    ok = F.col("status") == "success"
    sync_fns = F.filter("functions", lambda f: ~f["is_async"])
    if name == "long_function":
        hits = F.filter(sync_fns, lambda f: f["end_line"] - f["line"] > LONG_FUNCTION_LINES)
        return F.transform(hits, lambda f: _f(f["line"], description=F.format_string(
            LONG_FUNCTION_MESSAGE, f["name"], f["end_line"] - f["line"]), **_smell(SMELL_TITLES[name])))
    if name == "too_many_parameters":
        hits = F.filter(sync_fns, lambda f: F.size(f["args"]) > MAX_PARAMETERS)
        return F.transform(hits, lambda f: _f(f["line"], description=F.format_string(
            TOO_MANY_PARAMETERS_MESSAGE, f["name"], F.size(f["args"])), **_smell(SMELL_TITLES[name])))
    if name == "god_class":
        hits = F.filter("classes", lambda c: c["end_line"] - c["line"] > GOD_CLASS_LINES)
        return F.transform(hits, lambda c: _f(c["line"], description=F.format_string(
            GOD_CLASS_MESSAGE, c["name"], c["end_line"] - c["line"]), **_smell(SMELL_TITLES[name])))
    if name == "magic_number":
        # the reference scans lines only after the file parsed
        return F.when(ok, F.transform("magic_lines", lambda ln: _f(ln, description=MAGIC_MESSAGE,
                                                                   **_smell(SMELL_TITLES[name])))).otherwise(_empty())
    if name == "complexity":
        hits = F.filter("functions", lambda f: f["complexity"] > COMPLEXITY_LIMIT)
        return F.transform(hits, lambda f: _f(
            f["line"], "high", "performance", "performance", COMPLEXITY_TITLE,
            F.format_string(COMPLEXITY_MESSAGE, f["name"], f["complexity"]), False))
    if name == "unsafe_call":
        return F.when(F.col("unsafe_call"), F.array(_f(None, "high", "security", "security", UNSAFE_TITLE,
                                                       UNSAFE_DESCRIPTION, False))).otherwise(_empty())
    if name == "missing_docstring":
        return F.when(F.col("missing_docstring"), F.array(_f(None, "low", "static", "style", DOCSTRING_TITLE,
                                                             DOCSTRING_DESCRIPTION, False))).otherwise(_empty())
    raise ValueError(f"unknown detector {name}")


def to_findings(df: DataFrame, arr: Column) -> DataFrame:
    """Explode an array of finding structs (with ``repo_id``, ``path`` on ``df``) to findings rows."""
    exploded = df.select("repo_id", F.col("path").alias("file"), F.explode(arr).alias("x"))
    stage_order = F.element_at(F.create_map(*[v for s, o in STAGE_ORDER.items() for v in (F.lit(s), F.lit(o))]),
                               F.col("x.stage"))
    out = exploded.select(
        "repo_id", "file", "x.line", F.lit(None).cast("int").alias("column"), "x.severity", "x.category",
        "x.title", "x.description", "x.auto_fixable", "x.stage", stage_order.alias("stage_order"),
        F.coalesce(F.col("x.line"), F.lit(0)).cast("long").alias("seq"),
    )
    return complete_findings(out)


def complete_findings(df: DataFrame) -> DataFrame:
    """Fill the optional finding fields with nulls, add the content-hash id, fix the column order."""
    for name in FINDING_COLUMNS:
        if name not in df.columns:
            if name == "references":
                df = df.withColumn(name, F.lit(None).cast("array<string>"))
            elif name == "cvss_score":
                df = df.withColumn(name, F.lit(None).cast("double"))
            elif name in ("line", "column", "stage_order"):
                df = df.withColumn(name, F.lit(None).cast("int"))
            elif name == "seq":
                df = df.withColumn(name, F.lit(0).cast("long"))
            elif name == "auto_fixable":
                df = df.withColumn(name, F.lit(False))
            elif name != "id":
                df = df.withColumn(name, F.lit(None).cast("string"))
    df = df.withColumn("id", finding_id())
    return df.select(*FINDING_COLUMNS)


def findings_array(detectors=None) -> Column:
    """The findings of the named detectors in one facts row, as an array of structs.

    A file that does not parse has no facts, but still the findings that read its text."""
    arrays = [F.coalesce(_detector_array(d), _empty()) for d in detectors or ALL_DETECTORS]
    return arrays[0] if len(arrays) == 1 else F.concat(*arrays)


def detect(facts_or_files: DataFrame, detectors=None) -> DataFrame:
    """Run the named detectors over ``file_facts`` (or over prepared files when none needs the parse)."""
    return to_findings(facts_or_files, findings_array(detectors))


def review_findings(files: DataFrame, detectors=None, partitions: int | None = None) -> DataFrame:
    """``source_files`` → findings of the chosen detectors, parsing only if one needs it."""
    detectors = list(detectors or ALL_DETECTORS)
    if PARSE_DETECTORS & set(detectors):
        base = file_facts(files, partitions=partitions)
    else:
        base = prepare_files(files)
    return detect(base, detectors)


def magic_lines(files: DataFrame) -> DataFrame:
    """D4 on the lines of files in other known languages than Python, which are not parsed."""
    other = known_files(files).where(~F.col("path").endswith(".py"))
    lines = other.select("repo_id", "path", F.posexplode(split_lines(normalize_newlines("content"))).alias("_pos", "_line")) \
        .where(F.col("_line").rlike(MAGIC_REGEX))
    return to_findings(lines, F.array(_f(F.col("_pos") + 1, description=MAGIC_MESSAGE, **_smell(SMELL_TITLES["magic_number"]))))


def n_plus_one(facts: DataFrame, verbs=None) -> DataFrame:
    """Calls to a query verb inside a loop → one performance finding per call."""
    verbs = list(verbs or QUERY_VERBS)
    calls = facts.select("repo_id", "path", F.explode("calls").alias("c"))
    last = F.element_at(F.split(F.col("c.name"), r"\."), -1)
    hits = calls.filter((F.col("c.loop_depth") > 0) & last.isin(verbs))
    arr = F.array(_f(F.col("c.line"), "medium", "performance", "performance", "Possible N+1 query",
                     F.format_string("Call %s inside a loop (depth %d)", F.col("c.name"), F.col("c.loop_depth")),
                     False))
    return to_findings(hits, arr)
