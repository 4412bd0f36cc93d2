"""Mixing sources to target weights by Pfair scheduling.

A source with integer share ``a`` of a period of ``W`` slots (the shares sum to ``W``) should have emitted
``t * a / W`` blocks by slot ``t``. Its block ``j`` (from 0) is released at slot ``floor(j * W / a)`` and due by
``ceil((j + 1) * W / a)``. In every slot the released block with the earliest deadline runs (ties: source
name). On one sequence of slots whose shares fill it exactly, every deadline is met, so each source stays
less than one block from its target at every slot, and the schedule repeats after ``W`` slots. One period is
therefore folded in SQL, a table bounded by the shares, and every block finds its slot by an equi-join:
``slot = (block div a) * W + slot of (block mod a)``.

Rows of a source are ranked by the md5 of the id in buckets of its leading digits: row numbers inside a
bucket, and bucket counts summed, so a source that holds most rows is spread over 4096 groups.

All rows are kept, each once. A source that runs out leaves its later slots empty: rows before the first
such slot have ``on_target`` true, the rest keep the ratio of the sources still there. Null sources count
as the source ``''``. Rows that repeat an id are each placed; which of two equal rows comes first is open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revline.llm.common import fresh
from revline.session import materialize


def square_root_shares(docs: DataFrame, source_col: str = "source", resolution: int = 1000) -> DataFrame:
    """(source, share): integer shares in proportion to the square root of the row counts."""
    n = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).count()
    root = F.sqrt(F.col("count").cast("double"))
    total = F.sum(root).over(Window.partitionBy())  # one row per source
    return n.select("source", F.greatest(F.lit(1), F.floor(resolution * root / total + 0.5)).cast("long").alias("share"))


def period(shares: DataFrame) -> DataFrame:
    """(source, share, slots, j, at): the slot of each block of one period, earliest deadline first."""
    one = shares.where("share > 0").agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("s"))
    one = one.where(F.size("s") > 0).withColumn("slots", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["share"]))

    def step(state, t):
        def due(done, i):
            share = F.element_at("s", i + 1)["share"]
            slots = F.col("slots")
            released = (done < share) & (F.floor(done * slots / share) <= t)
            return F.when(released, F.struct(F.ceil((done + 1) * slots / share).alias("due"), i.alias("i")))
        pick = F.array_min(F.transform(state["done"], due))["i"]
        return F.struct(
            F.transform(state["done"], lambda d, i: F.when(i == pick, d + 1).otherwise(d)).alias("done"),
            F.array_append(state["run"], F.struct(pick.alias("i"), F.element_at(state["done"], pick + 1).alias("j"), t.alias("at"))).alias("run"))

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("done"),
                     F.array().cast("array<struct<i:int,j:bigint,at:bigint>>").alias("run"))
    run = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), start, step, lambda z: z["run"])
    return one.select("s", "slots", F.explode(run).alias("r")).select(
        F.element_at("s", F.col("r.i") + 1)["source"].alias("source"),
        F.element_at("s", F.col("r.i") + 1)["share"].alias("share"), "slots", F.col("r.j").alias("j"), F.col("r.at").alias("at"))


def interleave(docs: DataFrame, shares: DataFrame, id_col: str = "doc_id", source_col: str = "source",
               block_rows: int = 32, names: tuple[str, ...] = ("block", "slot", "position", "on_target")) -> DataFrame:
    """``docs`` with block, slot, position (sort by it to read the mix) and ``on_target``.

    A source without a share follows after all others, in the order of its rank (slot and position null).
    """
    c = {n: fresh(docs.columns, f"_{n}") for n in ("key", "md5", "bucket", "row", "before", "rank", "share", "slots", "j", "at", "end")}
    keyed = docs.withColumn(c["key"], F.coalesce(F.col(source_col), F.lit(""))) \
        .withColumn(c["md5"], F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit(""))) \
        .withColumn(c["bucket"], F.substring(c["md5"], 1, 3))
    counts = keyed.groupBy(c["key"], c["bucket"]).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(c["key"]).orderBy(c["bucket"])
    offsets = counts.withColumn(c["before"], F.sum("n").over(upto) - F.col("n"))
    sizes = offsets.groupBy(c["key"]).agg(F.sum("n").alias("n"))
    plan = period(shares).join(sizes.select(F.col(c["key"]).alias("source"), "n"), "source")
    blocks = F.ceil(F.col("n") / block_rows)
    # The first slot a source cannot fill: that of the block after its last.
    empty = F.when(blocks % F.col("share") == F.col("j"), F.floor(blocks / F.col("share")) * F.col("slots") + F.col("at"))
    plan = plan.withColumn("end", F.min(empty).over(Window.partitionBy()))  # bounded by the period
    plan = plan.select(F.col("source").alias(c["key"]), F.col("share").alias(c["share"]), F.col("slots").alias(c["slots"]),
                       F.col("j").alias(c["j"]), F.col("at").alias(c["at"]), F.col("end").alias(c["end"]))
    share_of = plan.groupBy(c["key"]).agg(F.first(c["share"]).alias(c["share"]))
    offsets = offsets.join(share_of, c["key"], "left")  # counts by bucket: the rows themselves never meet by source
    inside = Window.partitionBy(c["key"], c["bucket"]).orderBy(c["md5"], F.col(id_col))
    ranked = keyed.withColumn(c["row"], F.row_number().over(inside)) \
        .join(offsets.drop("n"), [c["key"], c["bucket"]]) \
        .withColumn(c["rank"], F.col(c["before"]) + F.col(c["row"]) - 1) \
        .withColumn(names[0], F.floor(F.col(c["rank"]) / block_rows)) \
        .withColumn(c["j"], F.col(names[0]) % F.col(c["share"]))
    placed = ranked.join(plan.drop(c["share"]), [c["key"], c["j"]], "left")
    slot = F.floor(F.col(names[0]) / F.col(c["share"])) * F.col(c["slots"]) + F.col(c["at"])
    return placed.withColumn(names[1], slot) \
        .withColumn(names[2], F.col(names[1]) * block_rows + F.col(c["rank"]) % block_rows) \
        .withColumn(names[3], F.coalesce(F.col(names[1]) < F.col(c["end"]), F.lit(False))) \
        .select(*docs.columns, *names)


def written_places(docs: DataFrame, parts: int, names: tuple[str, str] = ("position", "part")) -> DataFrame:
    """``docs`` with the position of each row (from 0) in the written table, and its part of ``parts`` even stretches.

    The order is that of the writing tasks, their files, and the rows of a file; a reader deals files to tasks in
    another one. ``docs`` is the plain read of a written table; any other frame is written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = materialize(docs, "written")
    c = {n: fresh(docs.columns, f"_{n}") for n in ("path", "index", "before", "total")}
    meta = docs.metadataColumn("_metadata")
    rows = docs.select("*", meta["file_path"].alias(c["path"]), meta["row_index"].alias(c["index"]))
    name = F.regexp_extract(c["path"], "[^/]*$", 0)
    number = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("long")
    upto = Window.partitionBy().orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)\."), c["path"])  # one row for each file
    files = rows.groupBy(c["path"]).agg(F.count("*").alias("n")) \
        .select(c["path"], (F.sum("n").over(upto) - F.col("n")).alias(c["before"]), F.sum("n").over(Window.partitionBy()).alias(c["total"]))
    position = F.col(c["before"]) + F.col(c["index"])
    return rows.join(F.broadcast(files), c["path"]).select(
        *docs.columns, position.alias(names[0]), F.floor(position * parts / F.col(c["total"])).cast("int").alias(names[1]))
