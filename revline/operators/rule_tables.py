"""D8, D11, D16 with the rules in a table: thousands of rules without an expression for each.

``rules(rule_id, regex, literal, severity, cwe_id, title)``; ``literal`` is a text that every match contains (null
or shorter than three characters: none). Each rule is listed under the rarest three characters of its literal, as
counted in a bounded sample of the texts (the choice changes cost only). A line is cut to its distinct three-character
pieces, those meet the list by an equi-join, and what meets is verified: the line must hold the literal and match
the regular expression, both taken from the row. Rules without a literal go their own way: they are packed in rows
of ``PACK`` rules, dealt over ``SPREAD`` keys, and each line tests the packs that share its key.

Defined results: as ``operators.rules.scan_rules``: one row per line and rule; null texts have no lines; rules with
a null id or regex take no part; rows that repeat a rule count once; a regular expression that does not compile
fails the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revline.functions.text import normalize_newlines, split_lines
from revline.session import materialize

GRAM = 3
HELD_ROWS = 50_000  # rules that may be copied to every task; more are joined by a shuffle
PACK = 64          # rules without a literal that a line tests in one row
SPREAD = 32        # keys that lines and packs are dealt over
SAMPLE_ROWS = 500  # texts in which pieces are counted to choose the rarest

DETAILS = ["severity", "cwe_id", "title"]


RULE_SCHEMA = "rule_id string, regex string, literal string, severity string, cwe_id string, title string"


def rule_table(spark, rules: list[dict]) -> DataFrame:
    """A list of rules (as in ``operators.rules``) as a table."""
    cols = ["rule_id", "regex", "literal", *DETAILS]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rules], RULE_SCHEMA)


def grams(text):
    """Distinct three-character pieces of a text, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), 1))


def _clean(rules: DataFrame) -> DataFrame:
    cols = ["rule_id", "regex", "literal", *[c for c in DETAILS if c in rules.columns]]
    return rules.where(F.col("rule_id").isNotNull() & F.col("regex").isNotNull()).select(*cols).distinct()


def listed(rules: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Rules with a literal, each listed once under its rarest piece, ``_gram``."""
    known = rules.where(F.length("literal") >= GRAM)
    pieces = known.select("rule_id", "regex", F.explode(grams(F.col("literal"))).alias("_gram"))
    seen = docs.select(F.col(text).alias("_t")).limit(SAMPLE_ROWS).select(F.explode(grams(F.col("_t"))).alias("_gram")) \
        .groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = pieces.join(seen, "_gram", "left").groupBy("rule_id", "regex") \
        .agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    return known.join(rarest, ["rule_id", "regex"])


def matches(texts: DataFrame, rules: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, rule columns) of every rule that matches a text; the text may have any length."""
    rules = materialize(_clean(rules), "rules")  # its rows are counted: what is copied to every task is bounded
    held = rules.count() <= HELD_ROWS
    near = F.broadcast if held else lambda df: df.hint("merge")
    details = [c for c in rules.columns if c not in ("regex", "literal")]
    rows = texts.select(*keys, F.col(text).alias("_line")).where(F.col("_line").isNotNull())
    by_gram = rows.select("*", F.explode(grams(F.col("_line"))).alias("_gram")).join(near(listed(rules, rows, "_line")), "_gram") \
        .where(F.contains("_line", "literal") & F.regexp_like("_line", F.col("regex"))).select(*keys, *details)
    # the others, dealt by a hash to as many packs as their number asks for
    plain = rules.where(F.coalesce(F.length("literal"), F.lit(0)) < GRAM)
    pack = F.struct(F.col("regex"), F.coalesce("literal", F.lit("")).alias("literal"), *details)
    wanted = plain.select(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PACK))).scalar()
    numbered = plain.withColumn("_p", F.pmod(F.xxhash64("rule_id", "regex"), wanted))
    packs = numbered.groupBy("_p").agg(F.collect_list(pack).alias("_rules")) \
        .withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    tested = rows.withColumn("_s", F.pmod(F.xxhash64("_line", *keys), F.lit(SPREAD)).cast("int")).join(near(packs), "_s")
    hits = F.filter("_rules", lambda r: F.contains(F.col("_line"), r["literal"]) & F.regexp_like(F.col("_line"), r["regex"]))
    by_test = tested.select(*keys, F.explode(hits).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in details])
    return by_gram.unionByName(by_test)


def scan_rule_table(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """D8 with rules in a table: key, line_no, rule_id, severity, cwe_id, title of every matching line."""
    lines = docs.select(key, F.posexplode(split_lines(normalize_newlines(text))).alias("_pos", "_text")) \
        .select(key, (F.col("_pos") + 1).alias("line_no"), "_text")
    return matches(lines, rules, "_text", [key, "line_no"])


def violations(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """D16 with rules in a table: (key, rule_id) of every broken rule.

    ``rules(rule_id, must_match, must_not_match, literal)``: a text breaks a rule if it matches ``must_not_match`` or
    does not match ``must_match`` (a null text matches nothing). The ids of the rules that must match travel with
    each text once, as one array.
    """
    docs = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_doc"))
    asked = rules.select("rule_id", F.col("must_match").alias("regex"), "literal").where("regex is not null")
    barred = rules.select("rule_id", F.col("must_not_match").alias("regex"), "literal").where("regex is not null")
    broken = matches(docs, barred, "_doc", [key]).select(key, "rule_id")
    every = F.coalesce(asked.where("rule_id is not null").agg(F.collect_set("rule_id").alias("r")).scalar(), F.array().cast("array<string>"))
    met = matches(docs, asked, "_doc", [key]).groupBy(F.col(key).alias("_key")).agg(F.collect_set("rule_id").alias("_met"))
    missing = docs.select(key).join(met, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        key, F.explode(F.array_except(every, F.coalesce("_met", F.array().cast("array<string>")))).alias("rule_id"))
    return broken.unionByName(missing)
