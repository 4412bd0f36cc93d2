"""B4 to B6 on a commit graph: files at any commit, changes between commits, merge bases.

``commits(repo_id, commit, parent, parent_no)``: a row for each parent of a commit (``parent_no`` 0 is the first
parent; a root has one row with a null parent). ``versions(repo_id, path, commit, content, is_deleted)``: what a
commit wrote. Branches and merges are followed; the linear form is in ``operators.versions``.

A history falls into **lines**: a commit continues the line of its first parent if it is that parent's smallest
child, and starts a line otherwise. Line and position of every commit come from links resolved inside sorted batches and
pointer doubling between them (joins; as many rounds as the longest line has binary digits, over one commit for each
stretch of a line that lies in a batch; in an order that tells nothing, over all commits). Whoever reaches a commit reaches all of its line before it, so the
ancestors of a commit are one position for each line, and are found by rounds of joins over the edges between
lines only: as many rounds as lines lie nested, whatever the depth. Long lines are joined by stretches of
``STRETCH`` positions, so a repository with most of all commits is spread.

``order_col``: a number that should grow from parent to child (commit time, sequence number). Where it does not
(clock skew), the child counts as one later than its parent, in rounds over the commits still wrong. The version
of a file at a commit is that of the latest ancestor (itself included) in this order, then the larger commit name:
on one line of descent the last one, between unmerged lines the later one.

Defined results: rows with a null repository or commit take no part; unknown parents end a history; repeated rows
count once; a commit that writes a path twice keeps the larger (is_deleted, content); a cycle raises ValueError.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revline.session import materialize

STRETCH = 4096  # positions of a line that are joined under one key


def _clean(commits: DataFrame) -> DataFrame:
    return commits.where(F.col("repo_id").isNotNull() & F.col("commit").isNotNull())


def _climb(batches):
    """Resolves links inside a batch: each commit's topmost commit reached in it and the steps up to there."""
    for pdf in batches:
        n = len(pdf)
        place = {key: i for i, key in enumerate(zip(pdf["repo_id"], pdf["commit"]))}
        parent = np.fromiter((place.get(key, -1) for key in zip(pdf["repo_id"], pdf["jump"])), np.int64, n)
        to, up = np.where(parent >= 0, parent, np.arange(n)), (parent >= 0).astype(np.int64)
        for _ in range(n.bit_length()):
            up, to = up + up[to], to[to]
        round_about = parent[to] >= 0  # on a cycle: left to the rounds between batches, which find it
        to, up = np.where(round_about, np.arange(n), to), np.where(round_about, 0, up)
        yield pdf.assign(top=pdf["commit"].to_numpy()[to], up=up)[["repo_id", "commit", "jump", "top", "up"]]


def lines(commits: DataFrame, order_col: str | None = None) -> DataFrame:
    """(repo_id, commit, line, pos) of every commit: the first commit of its line and the steps from there.

    Commits are sorted by repository and ``order_col`` (which changes cost only) and each Arrow batch of them resolves
    the links inside it, so the rounds of pointer doubling run over the topmost commits of the batches alone."""
    known = _clean(commits)
    order = F.max(F.coalesce(F.col(order_col).cast("long"), F.lit(0))) if order_col else F.lit(0).cast("long")
    names = known.groupBy("repo_id", "commit").agg(order.alias("_order"))
    first = known.where(F.col("parent").isNotNull()).groupBy("repo_id", "commit") \
        .agg(F.min_by("parent", F.struct("parent_no", "parent")).alias("parent"))
    # the child that continues its first parent's line; a parent without a row of its own starts none
    heir = first.join(names.select("repo_id", F.col("commit").alias("parent")), ["repo_id", "parent"], "left_semi") \
        .groupBy("repo_id", "parent").agg(F.min("commit").alias("commit"))
    linked = names.join(heir, ["repo_id", "commit"], "left").select("repo_id", "_order", "commit", F.col("parent").alias("jump"))
    sorted_ = ["repo_id", "_order", "commit"]
    schema = T.StructType([linked.schema["repo_id"], linked.schema["commit"], linked.schema["jump"],
                           T.StructField("top", linked.schema["commit"].dataType), T.StructField("up", T.LongType())])
    near = materialize(linked.repartitionByRange(*[F.col(c) for c in sorted_]).sortWithinPartitions(*sorted_).mapInPandas(_climb, schema), "climbed")
    above = near.select("repo_id", F.col("commit").alias("jump"), F.col("top").alias("_top"), (F.col("up") + 1).alias("_up"))
    at = near.where("commit = top").join(above, ["repo_id", "jump"], "left").select(
        "repo_id", "commit", F.col("_top").alias("jump"), F.coalesce("_up", F.lit(0)).alias("pos"), F.when(F.col("_top").isNull(), F.col("commit")).alias("line"))
    at = materialize(at, "lines")
    left = None
    while True:
        now = at.where("jump is not null").count()
        if not now:
            break
        if now == left:  # every round settles some commit of a line that has a start
            raise ValueError("the commit graph has a cycle of first parents")
        left = now
        to = at.select("repo_id", F.col("commit").alias("jump"), F.col("jump").alias("_jump"), F.col("pos").alias("_pos"), F.col("line").alias("_line"))
        moved = at.where("jump is not null").join(to, ["repo_id", "jump"]) \
            .select("repo_id", "commit", F.col("_jump").alias("jump"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_line").alias("line"))
        at = materialize(moved.unionByName(at.where("jump is null")), "lines")
    tops = at.select("repo_id", F.col("commit").alias("top"), "line", "pos")
    return materialize(near.join(tops, ["repo_id", "top"]).select("repo_id", "commit", "line", (F.col("pos") + F.col("up")).alias("pos")), "on-lines")


def ordered(commits: DataFrame, order_col: str) -> DataFrame:
    """(repo_id, commit, at): ``order_col``, raised where a commit is not later than a parent (null counts as 0)."""
    known = _clean(commits)
    at = materialize(known.groupBy("repo_id", "commit").agg(F.max(F.coalesce(F.col(order_col).cast("long"), F.lit(0))).alias("at")), "ordered")
    edges = known.where("parent is not null").select("repo_id", "commit", "parent").distinct()
    late = edges.join(at, ["repo_id", "commit"]).join(
        at.select("repo_id", F.col("commit").alias("parent"), F.col("at").alias("_before")), ["repo_id", "parent"])
    raised = materialize(late.where("at <= _before").groupBy("repo_id", "commit").agg((F.max("_before") + 1).alias("at")), "ordered")
    if raised.isEmpty():
        return at
    span = at.agg(F.max("at") + F.count(F.lit(1))).first()[0]
    while not raised.isEmpty():
        at = materialize(at.unionByName(raised).groupBy("repo_id", "commit").agg(F.max("at").alias("at")), "ordered")
        if not raised.where(F.col("at") > span).isEmpty():
            raise ValueError("the commit graph has a cycle")
        pushed = raised.select("repo_id", F.col("commit").alias("parent"), F.col("at").alias("_before")) \
            .join(edges, ["repo_id", "parent"]).groupBy("repo_id", "commit").agg((F.max("_before") + 1).alias("_new"))
        raised = materialize(pushed.join(at, ["repo_id", "commit"]).where("_new > at").select("repo_id", "commit", F.col("_new").alias("at")), "ordered")
    return at


def line_steps(commits: DataFrame, on_lines: DataFrame) -> DataFrame:
    """(repo_id, line, pos, to_line, to_pos, _s): the edges that lead from one line to another."""
    known = _clean(commits)
    place = lambda c, line, pos: on_lines.select("repo_id", F.col("commit").alias(c), F.col("line").alias(line), F.col("pos").alias(pos))
    steps = known.where("parent is not null").select("repo_id", "commit", "parent").distinct() \
        .join(place("commit", "line", "pos"), ["repo_id", "commit"]).join(place("parent", "to_line", "to_pos"), ["repo_id", "parent"]) \
        .where("line <> to_line")
    return materialize(steps.select("repo_id", "line", "pos", "to_line", "to_pos", F.expr(f"pos div {STRETCH}").alias("_s")), "steps")


def ancestors(commits: DataFrame, wanted: DataFrame, on_lines: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(repo_id, at, line, pos): the ancestors of each wanted commit ``(repo_id, at)``, itself included, as the
    positions up to ``pos`` of some lines; ``steps``: what ``line_steps`` has given for these commits."""
    steps = line_steps(commits, on_lines) if steps is None else steps
    start = wanted.select("repo_id", "at").distinct() \
        .join(on_lines.select("repo_id", F.col("commit").alias("at"), "line", "pos"), ["repo_id", "at"])
    found = materialize(start.select("repo_id", "at", "line", "pos"), "reach")
    new = found.withColumn("low", F.lit(-1).cast("long"))
    while not new.isEmpty():
        spread = new.withColumn("_s", F.explode(F.expr(f"sequence((low + 1) div {STRETCH}, pos div {STRETCH})"))) \
            .withColumnRenamed("pos", "high")
        reached = spread.join(steps, ["repo_id", "line", "_s"]).where("pos > low and pos <= high") \
            .groupBy("repo_id", "at", F.col("to_line").alias("line")).agg(F.max("to_pos").alias("_to"))
        more = reached.join(found, ["repo_id", "at", "line"], "left").where("pos is null or _to > pos") \
            .select("repo_id", "at", "line", F.col("_to").alias("pos"), F.coalesce("pos", F.lit(-1)).alias("low"))
        new = materialize(more, "reach")
        found = materialize(found.unionByName(new.drop("low")).groupBy("repo_id", "at", "line").agg(F.max("pos").alias("pos")), "reach")
    return found


class History:
    """A commit graph with the lines and the order of its commits, worked out once."""

    def __init__(self, commits: DataFrame, order_col: str):
        self.commits = commits
        self.lines = lines(commits, order_col)
        self.steps = line_steps(commits, self.lines)
        self.places = materialize(self.lines.join(ordered(commits, order_col).withColumnRenamed("at", "_order"), ["repo_id", "commit"]), "places")

    def files_at(self, versions: DataFrame, wanted: DataFrame) -> DataFrame:
        """(repo_id, at, path, commit, content) of every live file at each wanted commit ``(repo_id, at)``."""
        live = self._latest(versions, wanted, "content")
        return live.where(~F.col("v.is_deleted")).select("repo_id", "at", "path", "v.commit", F.col("v.content").alias("content"))

    def _latest(self, versions: DataFrame, wanted: DataFrame, value: str) -> DataFrame:
        reach = ancestors(self.commits, wanted, self.lines, self.steps) \
            .withColumn("_s", F.explode(F.expr(f"sequence(0L, pos div {STRETCH})"))).withColumnRenamed("pos", "high")
        rows = versions.select("repo_id", "path", "commit", F.col(value), F.coalesce("is_deleted", F.lit(False)).alias("is_deleted")) \
            .join(self.places, ["repo_id", "commit"]).withColumn("_s", F.expr(f"pos div {STRETCH}"))
        return rows.join(reach, ["repo_id", "line", "_s"]).where("pos <= high").groupBy("repo_id", "at", "path").agg(
            F.max_by(F.struct("commit", "is_deleted", value), F.struct("_order", "commit", "is_deleted", value)).alias("v"))

    def merge_bases(self, pairs: DataFrame) -> DataFrame:
        """(repo_id, a, b, base): the latest common ancestor of each pair of commits (null if they share none)."""
        pairs = pairs.select("repo_id", "a", "b").distinct()
        ends = pairs.select("repo_id", F.col("a").alias("at")).unionAll(pairs.select("repo_id", F.col("b").alias("at")))
        reach = ancestors(self.commits, ends, self.lines, self.steps)
        side = lambda c: reach.select("repo_id", F.col("at").alias(c), "line", F.col("pos").alias(f"_{c}"))
        both = pairs.join(side("a"), ["repo_id", "a"]).join(side("b"), ["repo_id", "b", "line"]) \
            .select("repo_id", "a", "b", "line", F.least("_a", "_b").alias("pos"))
        best = both.join(self.places, ["repo_id", "line", "pos"]).groupBy("repo_id", "a", "b") \
            .agg(F.max_by("commit", F.struct("_order", "commit")).alias("base"))
        return pairs.join(best, ["repo_id", "a", "b"], "left")

    def changed_files(self, versions: DataFrame, pairs: DataFrame, since_base: bool = False) -> DataFrame:
        """(repo_id, a, b, path, change_type) of the files that differ between commits a and b of each pair.

        ``since_base``: compare b with the merge base of both instead (what b's branch changed, "A...B"); without a
        common ancestor every file of b is added.
        """
        pairs = pairs.select("repo_id", "a", "b").distinct()
        ranges = self.merge_bases(pairs) if since_base else pairs.withColumn("base", F.col("a"))
        ends = ranges.select("repo_id", F.col("base").alias("at")).unionAll(ranges.select("repo_id", F.col("b").alias("at"))).where("at is not null")
        # digests travel, not contents; a null content is a content like any other
        told = versions.withColumn("_digest", F.sha2(F.col("content").cast("binary"), 256))
        live = materialize(self._latest(told, ends, "_digest").where(~F.col("v.is_deleted"))
                           .select("repo_id", "at", "path", F.col("v._digest").alias("_digest")), "live")
        side = lambda end, h, there: ranges.join(live.withColumnRenamed("at", end), ["repo_id", end]) \
            .select("repo_id", "a", "b", "path", F.col("_digest").alias(h), F.lit(True).alias(there))
        j = side("base", "_a", "_in_a").join(side("b", "_b", "_in_b"), ["repo_id", "a", "b", "path"], "full_outer")
        kind = F.when(F.col("_in_a").isNull(), F.lit("added")).when(F.col("_in_b").isNull(), F.lit("deleted")) \
            .when(~F.col("_a").eqNullSafe(F.col("_b")), F.lit("modified"))
        return j.select("repo_id", "a", "b", "path", kind.alias("change_type")).where("change_type is not null")
