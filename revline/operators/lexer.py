"""Where in a source text a line rule matches: in code, in a comment or in a string (Python, Java, TypeScript).

A text is read once by a state machine: code, line and block comments, strings with escapes, text blocks, and template
strings whose ``${...}`` holes are code again, nested to any depth. Only files that have a hit are read.

Defined results: a comment or text block that is not closed goes to the end of the text, another string to the end of
its line; quotes and brackets inside comments and strings mean nothing; a text of another language is all code.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revline.functions.text import normalize_newlines, split_lines
from revline.operators.languages import with_language
from revline.operators.rule_tables import HELD_ROWS

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("kind", T.StringType())]))

LINE, BLOCK = r"[^\n]*", r"(?:(?!\*/).)*(?:\*/)?"
LONG = {q: rf"(?:\\.|(?!{q}).)*(?:{q})?" for q in ('"""', "'''")}
SHORT = {q: rf"(?:\\.|[^\\\n{q}])*{q}?" for q in "\"'"}

# What opens a comment or a string in each language, longest first, and what it reaches to (None: a template string).
OPENERS = {
    "python": {"#": ("comment", LINE), '"""': ("string", LONG['"""']), "'''": ("string", LONG["'''"]), '"': ("string", SHORT['"']), "'": ("string", SHORT["'"])},
    "java": {"//": ("comment", LINE), "/*": ("comment", BLOCK), '"""': ("string", LONG['"""']), '"': ("string", SHORT['"']), "'": ("string", SHORT["'"])},
    "typescript": {"//": ("comment", LINE), "/*": ("comment", BLOCK), "`": ("string", None), '"': ("string", SHORT['"']), "'": ("string", SHORT["'"])},
}
_NEXT = {lang: re.compile("|".join(map(re.escape, openers)) + ("|[{}]" if lang == "typescript" else "")) for lang, openers in OPENERS.items()}
_REST = {lang: {o: (kind, re.compile(rest, re.S) if rest else None) for o, (kind, rest) in openers.items()} for lang, openers in OPENERS.items()}
_TEMPLATE = re.compile(r"(?:\\.|[^\\`$]|\$(?!\{)|\\\Z)*(`|\$\{|\Z)", re.S)


def spans(text: str | None, language: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the comments and strings of a text, in order."""
    if not text or language not in OPENERS:
        return []
    find, rest, out, at = _NEXT[language].search, _REST[language], [], 0
    holes: list[int] = []  # open brackets in each template hole around

    def template(start: int, at: int) -> int:
        end = _TEMPLATE.match(text, at)
        out.append((start, end.end(), "string"))
        if end.group(1) == "${":
            holes.append(0)
        return end.end()

    while m := find(text, at):
        sign, at = m.group(), m.end()
        if sign == "{":
            if holes:
                holes[-1] += 1
        elif sign == "}":
            if holes:
                holes[-1] -= 1
                if holes[-1] < 0:  # the hole ends: back in its template
                    holes.pop()
                    at = template(m.start(), at)
        elif rest[sign][1] is None:
            at = template(m.start(), at)
        else:
            at = rest[sign][1].match(text, at).end()
            out.append((m.start(), at, rest[sign][0]))
    return out


@F.pandas_udf(SPANS)
def spans_udf(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([spans(t, k) for t, k in zip(text, language)])


def placed(hits: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """``hits(repo_id, path, line_no, rule_id, ...)`` of ``files`` with ``place``: code, comment or string, where the rule's
    first match on the line starts. ``rules(rule_id, regex)`` names each rule once.

    Files meet their hits by a shuffle: texts and their lines are never copied to every task, whatever size the planner
    guesses for a text made by an expression. Rules, which may share one id among most hits, are, up to ``HELD_ROWS``."""
    named = rules.select("rule_id", "regex")
    held = named.count() <= HELD_ROWS
    touched = hits.select(F.col("repo_id").alias("_r"), F.col("path").alias("_p")).distinct()
    own = F.col("repo_id").eqNullSafe(F.col("_r")) & (F.col("path") == F.col("_p"))
    read = with_language(files.join(touched.hint("merge"), own, "left_semi"))
    text = normalize_newlines("content")
    told = read.select(F.col("repo_id").alias("_r"), F.col("path").alias("_p"), split_lines(text).alias("_lines"), spans_udf(text, "language").alias("_spans"))
    at = hits.join(F.broadcast(named) if held else named.hint("merge"), "rule_id").join(told.hint("merge"), own)
    before = F.aggregate(F.slice("_lines", F.lit(1), F.col("line_no") - 1), F.lit(0), lambda s, x: s + F.length(x) + 1)
    offset = before + F.greatest(F.regexp_instr(F.element_at("_lines", F.col("line_no")), F.col("regex")), F.lit(1)) - 1
    hit = F.filter("_spans", lambda s: (s["start"] <= F.col("_at")) & (F.col("_at") < s["stop"]))
    place = F.when(F.size(hit) > 0, F.element_at(hit, 1)["kind"]).otherwise(F.lit("code"))
    return at.withColumn("_at", offset).select(*hits.columns, place.alias("place"))
