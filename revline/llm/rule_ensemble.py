"""Quality classifier: a sparse ensemble of rules taken from tree paths.

Small regression trees are boosted on the logistic loss over statistics of the texts; every path from a
root to a node is one conjunctive rule. A lasso-penalised logistic regression over the rules keeps few
of them, and the surviving rules and weights are compiled to a Spark column expression, so scoring is a
projection. Fitting uses a bounded sample of labelled rows (``limit`` of ``text_stats.labelled``), which
the driver holds as a small matrix; scoring covers every row.

With no labelled rows the score is 0.5; with one class it is the smoothed share of that class.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revline.llm.text_stats import features

Rule = tuple[tuple[str, str, float], ...]  # statistic, "<=" or ">", threshold


def _split(x, g, h, edges, rows):
    """(statistic, edge) of the largest gain over the rows, or None."""
    best, at = 1e-6, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for j, cuts in enumerate(edges):
        if not len(cuts):
            continue
        b = x[rows, j]
        left_g, left_h, left_n = (np.cumsum(np.bincount(b, w, len(cuts) + 1))[:-1] for w in (g[rows], h[rows], None))
        gain = left_g ** 2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g ** 2 / (total_h + 1)
        gain[(left_n < 10) | (len(rows) - left_n < 10)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, at = float(gain[k]), (j, k)
    return at


def _tree(x, g, h, edges, drawn, rows, depth, path, rules, out):
    """Grow a tree on the drawn rows; note the path of every node, and each leaf's value for all its rows."""
    at = _split(x, g, h, edges, drawn) if depth and len(drawn) >= 20 else None
    if at is None:
        out[rows] = g[drawn].sum() / (h[drawn].sum() + 1)
        return
    j, k = at
    for op in ("<=", ">"):
        here = path + ((j, op, k),)
        rules.add(here)
        side = lambda r: r[(x[r, j] <= k) == (op == "<=")]
        _tree(x, g, h, edges, side(drawn), side(rows), depth - 1, here, rules, out)


def fit(values: np.ndarray, labels: np.ndarray, names: list[str], trees: int = 20, depth: int = 3,
        penalty: float = 1e-3, steps: int = 400, seed: int = 11) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules."""
    n = len(labels)
    y = labels.astype(float)
    prior = (y.sum() + 0.5) / (n + 1)
    bias = math.log(prior / (1 - prior))
    if n == 0 or y.min() == y.max():
        return bias, []
    rng = np.random.default_rng(seed)
    qs = np.concatenate([[0.002, 0.01], np.arange(1, 32) / 32, [0.99, 0.998]])
    edges = []
    for j in range(values.shape[1]):
        cuts = np.unique(np.concatenate([np.quantile(values[y == c, j], qs) for c in (0, 1)]))
        edges.append(cuts[cuts < values[:, j].max()])
    x = np.stack([np.searchsorted(c, values[:, j], side="left") for j, c in enumerate(edges)], 1)
    paths: set = set()
    f = np.full(n, bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(rng.random(n) < 0.6) if n > 200 else np.arange(n)
        step = np.zeros(n)
        _tree(x, y - p, p * (1 - p), edges, rows, np.arange(n), depth, (), paths, step)
        f += 0.3 * step
    masks, kept = {}, []
    for path in sorted(paths, key=lambda r: (len(r), r)):
        m = np.ones(n, bool)
        for j, op, k in path:
            m &= x[:, j] <= k if op == "<=" else x[:, j] > k
        key = m.tobytes()
        if 0 < m.sum() < n and key not in masks:
            masks[key] = True
            kept.append((path, m))
    if not kept:
        return bias, []
    r = np.stack([m for _, m in kept], 1).astype(np.float64)
    w, b = np.zeros(r.shape[1]), bias
    # Accelerated proximal gradient: logistic loss, soft threshold on the weights only.
    rate = 4.0 / max(np.linalg.norm(r.T @ r / n, 2) + 1, 1e-9)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(r @ vw + vb))) - y
        nw = vw - rate * (r.T @ e / n)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * e.mean()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vw, vb, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nt
        w, b = nw, nb
    out = []
    for (path, _), weight in zip(kept, w):
        if abs(weight) > 1e-6:
            out.append((tuple((names[j], op, float(edges[j][k])) for j, op, k in path), float(weight)))
    return float(b), out


def fit_sample(train: DataFrame, **options) -> tuple[float, list[tuple[Rule, float]]]:
    names = list(features())
    rows = train.orderBy(train.columns[0]).toPandas()
    return fit(rows[names].to_numpy(float), rows["_label"].to_numpy(int), names, **options)


def score(model: tuple[float, list[tuple[Rule, float]]]) -> Column:
    """The ensemble as one expression over the columns of ``text_stats``: 0 to 1."""
    bias, rules = model
    f = features()
    z = F.lit(bias)
    for rule, weight in rules:
        holds = reduce(lambda a, b: a & b, [f[s] <= t if op == "<=" else f[s] > t for s, op, t in rule])
        z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))
