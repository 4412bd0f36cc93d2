"""D10 through calls: loops whose body reaches a database query some calls further down.

A call belongs to the innermost function around its line. It leads to the functions of the same name (the last part
of a dotted name) in its own file, or, if the file has none, to those of that name anywhere in its repository. The
distance of a function is the number of calls from it to a query (0 if it makes one itself). Distances spread from
the queries backwards, one call a round, over functions not yet reached, so recursion ends by itself and a function
is one row however many ways lead to it. A call inside a loop to a function with a distance is a finding; calls of
names that many functions share are joined by (repository, name), never expanded to pairs of functions.

Defined results: calls outside functions count like any other; unknown names lead nowhere; of several functions of a
name the nearest to a query counts; a null repository is one of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revline.operators.detectors import QUERY_VERBS
from revline.session import materialize


def call_edges(facts: DataFrame) -> DataFrame:
    """(repo, path, fn, name, line, loop_depth): each call with the line of the function around it (0: none) and the last part of its name."""
    around = lambda c: F.array_max(F.transform(
        F.filter("functions", lambda f: (f["line"] <= c["line"]) & (c["line"] <= f["end_line"])), lambda f: f["line"]))
    rows = facts.select(F.coalesce("repo_id", F.lit("\0")).alias("repo"), "path", F.explode(F.transform("calls", lambda c: F.struct(
        F.coalesce(around(c), F.lit(0)).alias("fn"), F.element_at(F.split(c["name"], r"\."), -1).alias("name"), c["name"].alias("call"),
        c["line"].alias("line"), c["loop_depth"].alias("loop_depth")))).alias("c"))
    return rows.select("repo", "path", "c.*")


def query_distances(functions: DataFrame, edges: DataFrame, verbs=None) -> DataFrame:
    """(repo, path, fn, distance) of every function that reaches a query."""
    verbs = list(verbs or QUERY_VERBS)
    known = edges.join(functions.select("repo", "path", "name").distinct().withColumn("_near", F.lit(True)), ["repo", "path", "name"], "left")
    steps = materialize(known.where("fn > 0").select("repo", "path", "fn", "name", F.coalesce("_near", F.lit(False)).alias("near")).distinct(), "calls")
    new = materialize(edges.where((F.col("fn") > 0) & F.col("name").isin(verbs)).select("repo", "path", "fn").distinct().withColumn("distance", F.lit(0)), "reached")
    found, round_ = new, 0
    while not new.isEmpty():
        round_ += 1
        named = new.join(functions, ["repo", "path", "fn"])
        near = named.select("repo", "path", "name").distinct().join(steps.where("near"), ["repo", "path", "name"]).select("repo", "path", "fn")
        far = named.select("repo", "name").distinct().join(steps.where("not near"), ["repo", "name"]).select("repo", "path", "fn")
        reached = near.unionByName(far).distinct().join(found, ["repo", "path", "fn"], "left_anti")
        new = materialize(reached.withColumn("distance", F.lit(round_)), "reached")
        found = found.unionByName(new)
    return found


def loop_queries(facts: DataFrame, verbs=None) -> DataFrame:
    """(repo_id, path, line, call, calls): calls in loops that reach a query, with the number of calls down to it."""
    edges = materialize(call_edges(facts), "edges")
    functions = materialize(facts.select(F.coalesce("repo_id", F.lit("\0")).alias("repo"), "path", F.explode("functions").alias("f"))
                            .select("repo", "path", F.col("f.line").alias("fn"), F.col("f.name").alias("name")), "functions")
    reach = query_distances(functions, edges, verbs).join(functions, ["repo", "path", "fn"])
    own = reach.groupBy("repo", "path", "name").agg(F.min("distance").alias("_own"))
    any_ = reach.groupBy("repo", "name").agg(F.min("distance").alias("_any"))
    here = functions.select("repo", "path", "name").distinct().withColumn("_near", F.lit(True))
    loops = edges.where("loop_depth > 0").select("repo", "path", "line", "call", "name").distinct() \
        .join(here, ["repo", "path", "name"], "left").join(own, ["repo", "path", "name"], "left").join(any_, ["repo", "name"], "left")
    calls = F.when(F.col("_near"), F.col("_own")).otherwise(F.col("_any")) + 1
    return loops.select(F.when(F.col("repo") != "\0", F.col("repo")).alias("repo_id"), "path", "line", "call", calls.alias("calls")).where("calls is not null")
