"""Language routing by extension, primary language and frameworks per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: extensions the analyzers declare, frameworks by imported module ------------------
LANGUAGES = {".py": "python", ".java": "java", ".ts": "typescript", ".tsx": "typescript"}
FRAMEWORKS = {"django": "Django", "flask": "Flask", "fastapi": "FastAPI", "pyspark": "Spark",
              "pandas": "pandas", "numpy": "NumPy", "pytest": "pytest", "langgraph": "LangGraph",
              "langchain": "LangChain", "click": "Click"}
# -------------------------------------------------------------------------------------------------------


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    ext = F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1)
    m = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return files.withColumn("ext", ext).withColumn("language", F.coalesce(F.element_at(m, F.col("ext")), F.lit("other")))


def known_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Files whose extension names a known language."""
    return files.where(F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1).isin(list(LANGUAGES)))


def language_counts(files: DataFrame) -> DataFrame:
    return with_language(files).groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("n_files"))


def primary_language(files: DataFrame) -> DataFrame:
    """Most common known language per repo (ties → alphabetically first)."""
    counts = language_counts(files).filter(F.col("language") != "other")
    return counts.groupBy("repo_id").agg(
        F.min_by("language", F.struct((-F.col("n_files")).alias("a"), F.col("language").alias("b")))
        .alias("primary_language"),
        F.max("n_files").alias("n_files"))


def frameworks(imports: DataFrame) -> DataFrame:
    """Frameworks per repo from top-level imported modules."""
    top = F.split(F.col("module"), r"\.")[0]
    m = F.create_map(*[F.lit(x) for kv in FRAMEWORKS.items() for x in kv])
    return imports.select("repo_id", F.element_at(m, top).alias("framework")).filter(F.col("framework").isNotNull()) \
        .groupBy("repo_id").agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))
