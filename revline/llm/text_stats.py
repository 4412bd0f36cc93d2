"""Statistics of whole texts as DataFrame expressions (no Python on the workers).

Words are ``[^\\x20\\x09-\\x0D]+``. Repeated 8-word windows are found inside one row: each window is a
hash of its eight word hashes, equal neighbours of the sorted windows mark their positions, and the
words these cover are counted once. Only texts that have a repeated window sort anything.

A null text counts as empty; an empty text has zero everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
         "n_marks", "n_distinct_words"]


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), text.alias("_text"))
    trimmed = F.btrim("_text", F.lit(SPACES))
    d = base.select(
        id_col, "_text",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"))
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    d = d.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        count("\\p{Lu}").alias("n_upper"),
        count("[0-9]").alias("n_digits"),
        count("[!?;:]").alias("n_marks"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hash"))
    window = lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(WINDOW)])
    none = F.array().cast("array<bigint>")
    d = d.select(
        "*", F.size(F.array_distinct("_hash")).cast("long").alias("n_distinct_words"),
        F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_hash") - WINDOW), window))
        .otherwise(none).alias("_win"))
    repeated = F.size(F.array_distinct("_win")) < F.size("_win")
    pairs = F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select(id_col, *[c for c in d.columns if c.startswith("n_") or c == "word_chars"],
                 F.when(repeated, pairs).alias("_pairs"))
    same = lambda p, k: p["h"] == F.get("_pairs", k)["h"]
    at = F.filter("_pairs", lambda p, k: F.coalesce(same(p, k - 1), F.lit(False)) | F.coalesce(same(p, k + 1), F.lit(False)))
    d = d.withColumn("_at", F.array_sort(F.transform(at, lambda p: p["i"])))
    words = F.aggregate(
        F.transform("_at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select(id_col, *[F.coalesce(words, F.lit(0).cast("long")).alias(c) if c == "n_repeat_words" else F.col(c)
                              for c in STATS])


def features() -> dict[str, Column]:
    """Ratios that rules test, over the columns of ``text_stats``. Always a number."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "upper_ratio": ratio("n_upper", "word_chars"),
        "digit_ratio": ratio("n_digits", "word_chars"),
        "mark_ratio": ratio("n_marks", "word_chars"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "distinct_ratio": ratio("n_distinct_words", "n_words"),
    }


def labelled(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, limit: int) -> DataFrame:
    """Features and label (0/1) of about ``limit`` labelled rows at most, drawn by a hash of the id.

    Rows that label one id differently count as its larger label; null labels and ids are left out.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    n = known.count()
    span = 1 << 30
    part = known.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(span)) < min(span, span * limit // max(n, 1)))
    return stats.join(part, id_col).select(id_col, "_label", *[c.alias(n) for n, c in features().items()])
