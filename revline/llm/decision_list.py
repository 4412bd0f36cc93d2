"""Quality rules: a decision list learned by sequential covering, as Spark conditional expressions.

Every statistic is cut at quantiles of both classes. A rule is a conjunction of thresholds that covers
low-quality rows: it is grown condition by condition (largest information gain on two thirds of the
rows), pruned to the prefix with the best value (p - n) / (p + n) on the other third, and accepted while
its precision on all rows is high enough. Rows it covers are set aside and the next rule is grown. Each
step is one aggregate over the binned rows; the driver sees counts by statistic and bin only.

The result is an ordered list; ``verdict`` compiles it to ``CASE WHEN rule THEN false ... ELSE true``.
With no labelled rows, or one class, the list is empty and keeps everything.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revline.llm.text_stats import features
from revline.session import materialize

Condition = tuple[str, str, float]  # statistic, "<=" or ">", threshold
QUANTILES = [0.005, 0.02, *[i / 16 for i in range(1, 16)], 0.98, 0.995]


def _bin(name: str, cuts: list[float]) -> Column:
    value = F.col(name)
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < value))


def learn(train: DataFrame, max_rules: int = 10, max_conditions: int = 3, min_precision: float = 0.9,
          min_share: float = 0.001) -> list[list[Condition]]:
    """``train``: id, ``_label`` (1: good) and the statistics of ``features()``; a bounded sample."""
    names = list(features())
    low = F.col("_label") == 0
    cuts_of = train.groupBy(low.alias("low")).agg(*[F.percentile_approx(n, QUANTILES, 10_000).alias(n) for n in names]).collect()
    if len(cuts_of) < 2:
        return []
    cuts = {n: sorted({x for r in cuts_of for x in r[n]}) for n in names}
    # bin k holds values above exactly k cuts: "<= cut[k]" is bin <= k, "> cut[k]" is bin > k
    bins = materialize(train.select(
        low.cast("long").alias("p"), (~low).cast("long").alias("n"),
        (F.pmod(F.xxhash64(F.lit("grow"), F.col(train.columns[0])), F.lit(3)) < 2).alias("grow"),
        *[_bin(n, cuts[n]).alias(n) for n in names]), "rules")
    total = bins.count()

    def test(c: tuple[str, str, int]) -> Column:
        return F.col(c[0]) <= c[2] if c[1] == "<=" else F.col(c[0]) > c[2]

    def all_of(conditions) -> Column:
        return reduce(lambda a, b: a & b, map(test, conditions), F.lit(True))

    rules, left = [], bins
    while len(rules) < max_rules:
        rule, rows = [], left.where("grow")
        while len(rule) < max_conditions:
            table = {(r["stat"], r["bin"]): (r["p"], r["n"]) for r in rows.select(
                "p", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("bin")) for s in names])).alias("x"))
                .groupBy("x.stat", "x.bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()}
            p0 = sum(v[0] for k, v in table.items() if k[0] == names[0])
            n0 = sum(v[1] for k, v in table.items() if k[0] == names[0])
            if not p0 or not n0:
                break
            best = None
            for s in names:
                p = n = 0
                for k in range(len(cuts[s])):
                    p, n = p + table.get((s, k), (0, 0))[0], n + table.get((s, k), (0, 0))[1]
                    for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                        if a:
                            gain = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))
                            if best is None or gain > best[0]:
                                best = (gain, (s, op, k))
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
            rows = rows.where(test(best[1]))
        if not rule:
            break
        counts = left.where("not grow").agg(*[F.sum(F.when(all_of(rule[:i + 1]), F.col(c))).alias(f"{c}{i}")
                                              for i in range(len(rule)) for c in "pn"]).first()
        worth = []
        for i in range(len(rule)):
            p, n = counts[f"p{i}"] or 0, counts[f"n{i}"] or 0
            worth.append(((p - n) / (p + n) if p + n else -1.0, -i))
        rule = rule[:1 - max(worth)[1]]
        p, n = left.where(all_of(rule)).agg(F.sum("p"), F.sum("n")).first()
        p, n = p or 0, n or 0
        if p < max(5, min_share * total) or p < min_precision * (p + n):
            break
        rules.append([(s, op, float(cuts[s][k])) for s, op, k in rule])
        left = left.where(~all_of(rule))
    return rules


def condition(c: Condition) -> Column:
    value = features()[c[0]]
    return value <= c[2] if c[1] == "<=" else value > c[2]


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one expression over the columns of ``text_stats``: true to keep."""
    out = None
    for rule in rules:
        holds = reduce(lambda a, b: a & b, map(condition, rule))
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def describe(rules: list[list[Condition]]) -> list[str]:
    return [" and ".join(f"{s} {op} {t:g}" for s, op, t in rule) for rule in rules]
