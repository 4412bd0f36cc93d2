"""Driver tables (parquet) by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def few_splits(df: DataFrame) -> bool:
    """Is ``df`` too small for its reader to give every core a split? Told from the planner's size estimate: no job runs."""
    if df.isStreaming:
        return False
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = df._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes()
    return size < spark.sparkContext.defaultParallelism * split


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over the cores when the scan gives fewer partitions than there are cores.

    A parquet file written as one row group is read by one task (T10); hash partitioning the
    narrow input rows on ``keys`` lets the per-row work after it (generation, hashing, regexes,
    parsing) use every core. A large scan is already split by the reader and is left alone.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 2, *keys) if few_splits(df) else df


PART_BYTES = 1 << 20  # of a table file, for each part of rows that grow many times in their task


def parts(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Even parts for a table read from files: two for each core, more for a larger table, so that no part grows with it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism * 2, -(-size // part_bytes))


def load_balanced(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    return balanced(load(spark, sf_dir, name), *keys)


def spread_stream(df: DataFrame, *keys: str) -> DataFrame:
    """``balanced`` for a stream, whose batches have no size to tell beforehand: their narrow rows are always spread."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 2, *keys)
