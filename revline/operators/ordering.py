"""Per-group positions (``row_number`` semantics) that stay parallel when one group is huge.

A group of up to ``CHUNK_ROWS`` rows is one chunk. A larger one is cut into chunks along its leading order columns. A chunk of more than ``CHUNK_ROWS`` rows is cut further,
by a finer order column and by the leading characters of the last one (an id), as many as its size asks for. Rows are
numbered inside (group, chunk), and the sizes of a group's earlier chunks are added, so the rows of one large group
are spread evenly and only one row for each chunk ever meets by group. The plan is lazy and treats a null group or
order value as a value of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


CHUNK_ROWS = 4096


def _same(keys: list[str], suffix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in keys])


def chunks(df: DataFrame, group: str, order: list, chunk: list | None = None, finer: list | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns that tell the chunk of a row, and their names (the group first); see ``positions``."""
    parts = _cols(chunk if chunk is not None else order[:1])
    keys = [group, *[f"__chunk{i}" for i in range(len(parts))]]
    # at most one row for each CHUNK_ROWS rows: a bounded copy, so that the rows themselves are not dealt out for it
    crowded = F.broadcast(df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CHUNK_ROWS)
                          .select(F.col(group).alias(f"{group}__g"), F.lit(True).alias("__crowded")))
    cut = df.join(crowded, F.col(group).eqNullSafe(F.col(f"{group}__g")), "left") \
        .select(*df.columns, "__crowded", *[F.when(F.col("__crowded"), c).alias(k) for c, k in zip(parts, keys[1:])])
    if not finer:
        return cut, keys
    step, name = _cols(finer)
    # one hexadecimal digit of an id cuts to 16 parts
    digits = F.ceil(F.log(F.col("__n") / CHUNK_ROWS) / F.log(F.lit(16.0))).cast("int")
    large = F.broadcast(cut.where("__crowded").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CHUNK_ROWS)
                        .select(*[F.col(k).alias(f"{k}__l") for k in keys], digits.alias("__digits")))
    further = F.col("__digits").isNotNull()
    cut = cut.join(large, _same(keys, "__l"), "left").select(
        *cut.columns, F.when(further, step).alias("__step"), F.when(further, F.substring(name, F.lit(1), F.col("__digits"))).alias("__name"))
    return cut, [*keys, "__step", "__name"]


def positions(df: DataFrame, group: str, order: list, pos_col: str = "pos", chunk: list | None = None,
              finer: list | None = None, size_col: str | None = None) -> DataFrame:
    """Add ``pos_col`` = 1-based position of each row inside its ``group`` by ``order``.

    ``order`` should be a total order (end it with a unique key) for reproducible positions. ``chunk``: columns
    that never decrease along ``order`` (leading order columns, or coarser forms of them); default: the first.
    ``finer``: the order columns that cut a large chunk: the next one whole, then prefixes of a string column.
    ``size_col``: adds the rows of the group too.
    """
    cut, keys = chunks(df, group, order, chunk, finer)
    # one column for all keys: it compares with its nulls as values, so numbering and offsets share one exchange
    cut = cut.withColumn("__key", F.struct(*keys))
    own = Window.partitionBy("__key")
    extra = [F.count(F.lit(1)).over(own).alias("__size")] if size_col else []
    numbered = cut.select(*df.columns, "__key", F.row_number().over(own.orderBy(*_cols(order))).alias("__row"), *extra)
    # a group that is not large is one chunk, with nothing before it
    sizes = cut.where("__crowded").groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(f"__key.{group}")
    upto = whole.orderBy(*[f"__key.{k}" for k in keys[1:]])
    before = sizes.select(F.col("__key").alias("__key_b"), (F.sum("__n").over(upto) - F.col("__n")).alias("__before"),
                          F.sum("__n").over(whole).alias("__all"))
    placed = numbered.join(before, F.col("__key") == F.col("__key_b"), "left")
    out = [(F.coalesce("__before", F.lit(0)) + F.col("__row")).cast("long").alias(pos_col)]
    if size_col:
        out.append(F.coalesce("__all", "__size").alias(size_col))
    return placed.select(*df.columns, *out)


def group_sizes(df: DataFrame, group: str, name: str = "group_size") -> DataFrame:
    """Rows per group (partial aggregation makes this skew-safe)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias(name))
