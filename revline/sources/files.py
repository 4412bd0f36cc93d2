"""A1, A2: a corpus of source files from folders, or from a table.

Spark's own file sources skip zero-byte files (T5) and list on the driver; ``scan_tree`` reads a folder tree through a
data source of ours, which does neither. A table input has no such gap either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revline.functions.text import decode_utf8_ignore, decode_utf8_strict, normalize_newlines


def scan_corpus(spark: SparkSession, root: str, glob: str = "*.py", repo_id: str | None = None,
                errors: str = "strict") -> DataFrame:
    """Every file under ``root`` matching ``glob`` → (repo_id, path, content, error).

    ``errors='strict'``: undecodable files get null content and an error; ``'ignore'`` drops bad bytes.
    Paths are relative to ``root``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", glob).load(root)
    prefix = F.regexp_extract("path", r"^(.*?" + _escape(root.rstrip("/")) + r"/)", 1)
    rel = F.expr("substring(path, length(_prefix) + 1)")
    text = decode_utf8_strict("content") if errors == "strict" else decode_utf8_ignore("content")
    df = raw.select("path", "content").withColumn("_prefix", prefix).select(
        (F.lit(repo_id) if repo_id is not None else F.lit(root)).alias("repo_id"),
        rel.alias("path"), normalize_newlines(text).alias("content"),
        F.when(text.isNull(), F.lit("invalid UTF-8")).alias("error"))
    return df


def scan_tree(spark: SparkSession, root: str, suffixes=(".py",), repo_id: str | None = None, errors: str = "strict",
              depth: int = 1) -> DataFrame:
    """Every file under ``root`` with one of the suffixes, empty ones too → (repo_id, path, content, error).

    ``root`` must be a folder that every executor sees. Paths are relative to it and use ``/``. Undecodable files are
    as in ``scan_corpus``; unreadable ones have null content and an error. See ``sources.tree`` for ``depth``.
    """
    from revline.sources import tree
    spark.dataSource.register(tree.TreeSource)
    raw = spark.read.format(tree.TreeSource.name()).option("root", root).option("suffixes", "\n".join(suffixes)).option("depth", str(depth)).load()
    text = decode_utf8_strict("content") if errors == "strict" else decode_utf8_ignore("content")
    return raw.select(
        F.lit(repo_id if repo_id is not None else root).alias("repo_id"), "path", normalize_newlines(text).alias("content"),
        F.coalesce("error", F.when(F.col("content").isNotNull() & text.isNull(), F.lit("invalid UTF-8"))).alias("error"))


def _escape(s: str) -> str:
    import re
    return re.escape(s)


def corpus_from_table(df: DataFrame, repo: str = "repo_id", path: str = "path", content: str = "content") -> DataFrame:
    return df.select(F.col(repo).cast("string").alias("repo_id"), F.col(path).alias("path"),
                     normalize_newlines(content).alias("content"))


def load_policies(spark: SparkSession, folder: str) -> DataFrame:
    """A5: each file of a policy folder as one row (whole text, T6)."""
    return spark.read.text(folder, wholetext=True).select(
        F.input_file_name().alias("policy_id"), F.col("value").alias("text"))
