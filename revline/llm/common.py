"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revline.session import materialize


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def fresh(columns, name: str) -> str:
    """``name``, lengthened until no input column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def slices_by_bytes(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of about ``limit`` bytes each; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def append_columns(df: DataFrame, text_col: str, new: T.StructType, make: Callable[[], Callable],
                   drop_text: bool = True, limit: int = 4 << 20) -> DataFrame:
    """Add columns computed from whole texts, one Arrow slice of about ``limit`` bytes at a time.

    ``make()`` runs once per task and returns ``f(list of str or None) -> list of column lists``.
    All rows and the other columns of ``df`` pass through unchanged; a new column whose name one of them has gets a
    longer one (see ``fresh``).
    """
    kept = [f for f in df.schema.fields if not (drop_text and f.name == text_col)]
    names = [f.name for f in kept]
    added: list = []
    for f in new.fields:
        added.append(T.StructField(fresh([*names, *[g.name for g in added]], f.name), f.dataType))
    out = T.StructType(kept + added)

    def run(batches):
        schema = to_arrow_schema(out)
        f = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for a, b in slices_by_bytes(sizes, limit):
                part = batch.slice(a, b - a)
                cols = f(texts.slice(a, b - a).to_pylist())
                arrays = [part.column(part.schema.get_field_index(n)).cast(schema.field(i).type)
                          for i, n in enumerate(names)]
                arrays += [pa.array(c, type=schema.field(len(names) + i).type) for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, out)


def map_with_next(docs: DataFrame, id_col: str, text_col: str, new: T.StructType, make: Callable[[], Callable],
                  limit: int = 4 << 20) -> DataFrame:
    """(id, new columns) of every row, computed from its text and that of the next row by (id, text).

    ``make()`` runs once per task and returns ``f(neighbouring texts) -> list of columns``, one shorter than the
    texts: a value for each text but the last. Null texts are empty, null ids come first, and the first row of all
    follows the last. Rows are dealt in ranges of (id, hash of the text), so a repeated id spreads too; each range
    leaves its first and last text, and only these few meet across ranges.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")) \
        .withColumn("_hash", F.xxhash64("_text"))
    ordered = rows.repartitionByRange(parts, "_id", "_hash").sortWithinPartitions("_id", "_hash", "_text").select("_id", "_text")
    id_field = T.StructField("_id", rows.schema["_id"].dataType)
    ends = [T.StructField("_part", T.IntegerType()), T.StructField("_head", T.StringType()), T.StructField("_tail", T.StringType())]
    names = [f"_new{i}" for i in range(len(new))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, new)]
    whole = T.StructType([id_field, *fields, *ends])

    def run(batches):
        schema = to_arrow_schema(whole)
        f, part = make(), TaskContext.get().partitionId()
        head = last_id = last = None
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
            for a, b in slices_by_bytes(sizes, limit):
                ids, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist()
                if head is None:
                    head = texts[0]
                else:
                    ids, texts = pa.concat_arrays([last_id, ids]), [last, *texts]
                last_id, last = ids.slice(len(ids) - 1), texts[-1]
                if len(texts) > 1:
                    cols = [pa.array(c, type=schema.field(n).type) for c, n in zip(f(texts), names)]
                    cols += [pa.nulls(len(texts) - 1, schema.field(e.name).type) for e in ends]
                    yield pa.RecordBatch.from_arrays([ids.slice(0, len(ids) - 1), *cols], schema=schema)
        if head is not None:
            cols = [pa.nulls(1, schema.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([last_id, *cols, pa.array([part], pa.int32()), pa.array([head]), pa.array([last])], schema=schema)

    def run_ends(batches):
        schema = to_arrow_schema(T.StructType([id_field, *fields]))
        f = make()
        for batch in batches:
            for i in range(batch.num_rows):
                cols = f([batch.column(1)[i].as_py(), batch.column(2)[i].as_py()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), *[pa.array(c, type=schema.field(n).type) for c, n in zip(cols, names)]], schema=schema)

    found = materialize(ordered.mapInArrow(run, whole), "with-next")
    left = found.where(F.col("_part").isNotNull())
    used = sorted(r[0] for r in left.select("_part").collect())  # one number for each range
    after = spark.createDataFrame(list(zip(used, used[1:] + used[:1])), "_part int, _next int")
    pairs = left.select("_id", "_tail", "_part").join(after, "_part") \
        .join(left.select(F.col("_part").alias("_next"), F.col("_head").alias("_follows")), "_next").select("_id", "_tail", "_follows")
    closed = pairs.mapInArrow(run_ends, T.StructType([id_field, *fields]))
    both = found.where(F.col("_part").isNull()).select("_id", *names).unionByName(closed)
    return both.select(F.col("_id").alias(id_col), *[F.col(n).alias(f.name) for n, f in zip(names, new)])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id on an edge; component is the smallest id reachable.

    Large-star / small-star rounds as joins and aggregates. The edge list of each round is written
    to the shared checkpoint folder, so lineage stays short and a lost executor rereads files.
    Ends when a round changes nothing.
    """
    def both(e):
        return e.select(F.col("u"), F.col("v")).unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where("u <> v").distinct(), "cc")
    last = state(e)
    while last[0]:
        near = both(e)
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct(), "cc")
        now = state(e)
        if now == last:
            break
        last = now
    found = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return found.unionAll(roots.join(found.select("id"), "id", "left_anti"))
