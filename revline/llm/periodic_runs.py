"""Periodic runs of words by descending common prefixes.

A run is a stretch of consecutive words with smallest period q, at least ``exponent`` periods and ``least`` words
long, that no neighbouring word extends. The suffixes of a text are sorted by prefix doubling and neighbours get
their common prefix. Neighbours are then united by decreasing common prefix: each class is the ordered set of its
positions, the smaller set goes into the larger, and two positions that become adjacent have exactly the common
prefix of that step. Where their distance d is small against that prefix l, they seed a run: d + l words of
period d, if the words before them differ. Adjacency makes d the smallest period: a smaller one would have put a
position of the class between them before.

A run of period q needs a common prefix of max((exponent - 1) * q, least - q) words, ``window(...)`` at the least:
only positions whose window repeats in the text enter the classes, and texts without such a position nothing.
Texts of a slice are sorted together, with a separate sign after each, so no prefix crosses texts. Nothing is
shuffled; a slice is a few megabytes or one longer text.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; a repeated row gives
repeated results; words are what blanks (space, 0x09 to 0x0D) leave, numbered from 0.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from revline.llm.common import append_columns, fresh


class Numbers(dict):
    """A number for each different word, in order of appearance."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def window(exponent: int, least: int) -> int:
    """The shortest common prefix that a run can have with itself one period on."""
    return min(max((exponent - 1) * q, least - q, 1) for q in range(1, max(least, 2)))


def repeated_windows(x: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Positions whose ``width`` signs occur again in the same text (and, by a chance of hashing, a few others)."""
    n = len(x) - width + 1
    if n <= 1:
        return np.zeros(0, np.int64)
    h = text[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[k:k + n].astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    # first by 22 bits, so that most positions are settled without a sort
    low = h >> np.uint64(42)
    some = np.flatnonzero(np.bincount(low.astype(np.int64), minlength=1 << 22)[low.astype(np.int64)] > 1)
    order = some[np.argsort(h[some], kind="stable")]
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return np.sort(order[twice])


def suffix_order(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Positions sorted by (text, suffix) under the order of the signs, by prefix doubling over what is still equal."""
    n = len(x)
    key = text.astype(np.int64) * (int(x.max()) + 1) + x
    order = np.argsort(key, kind="stable")
    slots, rank, k = np.arange(n), np.empty(n, np.int64), 0
    at, old = order, key[order]
    while len(at):
        head = np.ones(len(at), bool)
        head[1:] = old[1:] != old[:-1]
        first = np.flatnonzero(head)
        order[slots] = at
        rank[at] = np.repeat(slots[first], np.diff([*first, len(at)]))
        open_ = ~(head & np.append(head[1:], True))  # not alone in its group
        at, slots = at[open_], slots[open_]
        k = 2 * k or 1
        old = rank[at] * n + rank[np.minimum(at + k, n - 1)]
        sort = np.argsort(old, kind="stable")
        at, old = at[sort], old[sort]
    return order


def common_prefixes(x: list, at: list, before: list, width: int) -> list:
    """Common prefix of each position with the one before it in suffix order; both share ``width`` signs.

    Positions come in ascending order: a prefix is at most one shorter than that of the position just before."""
    out, last, n = [], -2, 0
    for i, j in zip(at, before):
        n = n - 1 if i == last + 1 and n > width else width
        while x[i + n] == x[j + n]:
            n += 1
        out.append(n)
        last = i
    return out


def seeds(x: list, pairs, pos: list, exponent: int, least: int):
    """(start, length, period) of every run from (position number, position number, prefix), longest prefix first."""
    sets = [[k] for k in range(len(pos))]
    out, least_ratio = [], exponent - 1

    def look(a, b, prefix):
        d = pos[b] - pos[a]
        if prefix >= least_ratio * d and d + prefix >= least and x[pos[a] - 1] != x[pos[b] - 1]:
            out.append((pos[a], d + prefix, d))

    for i, j, prefix in pairs:
        large, small = sets[i], sets[j]
        if large is small:
            continue
        if len(large) < len(small):
            large, small = small, large
        n, m = len(large), len(small)
        if m == 1:
            k = small[0]
            sets[k] = large
            p = bisect_left(large, k)
            if p and prefix >= least_ratio * (pos[k] - pos[large[p - 1]]):
                look(large[p - 1], k, prefix)
            if p < n and prefix >= least_ratio * (pos[large[p]] - pos[k]):
                look(k, large[p], prefix)
            large.insert(p, k)
            continue
        places = []
        for t, k in enumerate(small):
            p = bisect_left(large, k)
            places.append(p)
            if p and (not t or small[t - 1] < large[p - 1]):
                look(large[p - 1], k, prefix)
            if p < n and (t == m - 1 or small[t + 1] > large[p]):
                look(k, large[p], prefix)
            sets[k] = large
        if 8 * m < n:
            for p, k in zip(reversed(places), reversed(small)):
                large.insert(p, k)
        else:
            large += small
            large.sort()  # two ascending stretches: one merge
    return out


def runs(texts: list[list], exponent: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words, by start and period."""
    found: list[list] = [[] for _ in texts]
    width = window(exponent, least)
    ids = Numbers()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(texts)), np.int64, sizes.sum())
    # one sign of its own after each text, one before all
    starts = np.cumsum(sizes + 1) - sizes
    x = np.empty(len(flat) + len(texts) + 1, np.int64)
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    x[1:][np.repeat(starts - 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    x[0] = len(ids) + len(texts)
    x[starts + sizes] = len(ids) + np.arange(len(texts))
    text = np.concatenate([[len(texts)], text])
    maybe = repeated_windows(x, text, width)
    if not len(maybe):
        return found
    # only texts with a repeated window are sorted
    named = np.unique(text[maybe])
    keep = np.zeros(len(texts) + 1, bool)
    keep[named] = True
    part = np.flatnonzero(keep[text])
    sub = np.concatenate([x[:1], x[part]])
    owner = np.concatenate([[len(texts)], text[part]])
    order = suffix_order(sub, owner)
    cand = np.zeros(len(sub), bool)
    cand[np.searchsorted(part, maybe) + 1] = True
    i, j = order[1:], order[:-1]
    near = cand[i] & cand[j] & (owner[i] == owner[j])
    i, j = i[near], j[near]
    reach = sub[np.minimum(np.arange(len(sub))[:, None] + np.arange(width), len(sub) - 1)] if width <= 8 else None
    same = (reach[i] == reach[j]).all(1) if reach is not None else np.array(
        [bool((sub[a:a + width] == sub[b:b + width]).all()) for a, b in zip(i, j)], bool)
    i, j = i[same], j[same]
    by = np.argsort(i)
    i, j = i[by], j[by]
    signs = sub.tolist()
    prefix = np.array(common_prefixes(signs, i.tolist(), j.tolist(), width), np.int64)
    pos = np.unique(np.concatenate([i, j]))
    a, b = np.searchsorted(pos, i), np.searchsorted(pos, j)
    down = np.argsort(-prefix, kind="stable")
    begin = np.searchsorted(owner[1:], named) + 1  # first place of each sorted text
    for s, n, q in seeds(signs, zip(a[down].tolist(), b[down].tolist(), prefix[down].tolist()), pos.tolist(), exponent, least):
        t = owner[s]
        found[t].append((int(s - begin[np.searchsorted(named, t)]), n, q))
    for f in found:
        f.sort(key=lambda r: (r[0], r[2]))
    return found


def collapse(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words outside runs and the first period of each run; a word goes if any run contains it later."""
    drop = np.zeros(len(words), bool)
    for s, n, q in found:
        drop[s + q:s + n] = True
    return [w for w, d in zip(words, drop.tolist()) if not d]


def periodic_runs(docs: DataFrame, text_col: str = "text", exponent: int = 4, least: int = 6, drop_text: bool = True,
                  names: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """``docs`` with the number of words, the runs and the collapsed text (kept words joined by one space) of each text.

    A result whose name an input column has gets a longer one (see ``fresh``).
    """
    def make():
        def f(texts):
            words = [t.encode().split() if t else [] for t in texts]
            found = runs(words, exponent, least)
            kept = [collapse(w, r) if r else w for w, r in zip(words, found)]
            return [[len(w) for w in words], found, [b" ".join(w).decode() for w in kept]]
        return f

    types = (T.LongType(), T.ArrayType(RUN), T.StringType())
    taken = [c for c in docs.columns if not (drop_text and c == text_col)]
    return append_columns(docs, text_col, T.StructType([T.StructField(fresh(taken, n), t) for n, t in zip(names, types)]), make, drop_text)
