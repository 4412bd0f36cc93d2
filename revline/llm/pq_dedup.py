"""Embedding near-duplicates by product quantisation.

Equal vectors are one node with a number of copies. An index is fitted on a bounded sample: coarse
centroids by k-means, and codebooks of the residuals in ``parts`` subspaces. Every vector is stored in the
inverted list of its nearest centroid with its residual codes and the exact length of what the codes lose.
Every vector is also a query: it probes the lists that can hold a neighbour, a table of subspace
distances gives asymmetric distances to the codes by lookup, and rows whose distance less their own code
error is within reach are compared by cosine in double precision.

Probes: a neighbour within Euclidean reach ``d`` (of unit vectors) lies in another list only if the query
is within ``d`` of the plane between the two centroids. The distances of two neighbours to the plane between
their lists sum to at most ``d``, so with ``reach * d`` and a reach of 0.5 (the default) or more at least one of
the two probes the other's list. A link that only one end's probes reach is counted for both ends, so links and
components are exact; a smaller reach may miss some. The code filter never drops a pair.

Lists are split in blocks of ``BLOCK`` rows and their queries in parts, so no group grows with the data;
blocks are held, queries stream past. A block emits link counts and spanning edges, not pairs.

Defined results: vectors that are null, zero, or hold null or non-finite numbers link with nothing;
vectors of unequal length compare as if filled with zeros; a null id links with nothing and is kept, with a
null component; rows that repeat an id share a component, and repeated rows count as copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from revline.llm.common import connected_components
from revline.session import materialize

SAMPLE = 16_384    # rows that the index is fitted on, at most
BLOCK = 4_096      # rows of a list held at once
QUERIES = 65_536   # queries of a list in one part
CELLS = 1 << 20    # query-by-row distances computed at once


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.searchsorted(near[order], full), axis=0)
        c[full] = sums / n[full, None]
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ c.T + (c ** 2).sum(1), 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Index:
    def __init__(self, sample: np.ndarray, lists: int, parts: int, codes: int, seed: int = 5):
        self.dim = sample.shape[1]
        self.parts = min(parts, self.dim)
        self.coarse = _kmeans(sample, lists, 8, seed)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.cuts = [(self.dim * i // self.parts, self.dim * (i + 1) // self.parts) for i in range(self.parts)]
        self.books = [_kmeans(np.ascontiguousarray(rest[:, a:b]), codes, 6, seed + i) for i, (a, b) in enumerate(self.cuts)]
        self.gaps = np.sqrt(_squares(self.coarse, self.coarse))

    def encode(self, x: np.ndarray, reach: float):
        """Own list, codes, length of the code error, and lists to probe, of unit vectors."""
        d = _squares(x, self.coarse)
        own = d.argmin(1)
        rest = x - self.coarse[own]
        codes = np.empty((len(x), self.parts), np.uint8)
        for i, (a, b) in enumerate(self.cuts):
            codes[:, i] = _nearest(np.ascontiguousarray(rest[:, a:b]), self.books[i])
        lost = np.sqrt(((rest - self.decode(codes)) ** 2).sum(1))
        gap = self.gaps[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            across = (d - d[np.arange(len(x)), own][:, None]) / (2 * gap)
        probe = (across <= reach + 1e-9) | (gap == 0)  # more than the rounding of a sum that is just within reach
        return own, codes, lost, probe

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def distances(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of the coded rows of one list (down) to unit queries (across).

        With b the coded row, |q - b|^2 = 1 + |b|^2 - 2 q.b, and q.b is a sum over subspaces of table entries: a
        query's products with the codewords. Tables have a line for each codeword, so a lookup copies lines.
        """
        row = self.coarse[which] + self.decode(codes)
        out = np.broadcast_to(((row ** 2).sum(1) + 1).astype(np.float32)[:, None], (len(codes), len(q))).copy()
        q32 = np.ascontiguousarray(q.T, np.float32)
        out -= 2 * (self.coarse[which].astype(np.float32) @ q32)
        for i, (a, b) in enumerate(self.cuts):
            out -= np.take((2 * self.books[i]).astype(np.float32) @ q32[a:b], codes[:, i], axis=0)
        return out


def _matrix(lists, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def _local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node number reachable from each of n nodes over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9,
                    reach: float = 0.5, parts: int = 8, codes: int = 256, lists: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("_id").isNotNull() & F.coalesce(finite & F.exists("_v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    nodes = rows.where("_ok").groupBy("_v").agg(F.min("_id").cast("long").alias("id"), F.count("*").alias("copies"))
    nodes = materialize(nodes.select("id", "copies", F.col("_v").alias("v")), "vectors")
    n, dim = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    rest = rows.where("not _ok").select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                                        F.col("_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return rest
    span = 1 << 30
    drawn = nodes.where(F.pmod(F.xxhash64(F.lit("pq"), "id"), F.lit(span)) < min(span, span * SAMPLE // n)) \
        .select("v").limit(2 * SAMPLE).collect()
    if not drawn:
        drawn = nodes.select("v").limit(1).collect()
    count = lists or max(1, min(4096, math.isqrt(n) // 2))
    index = spark.sparkContext.broadcast(Index(_unit(_matrix([r[0] for r in drawn], dim)), count, parts, codes))
    d = math.sqrt(2 - 2 * cosine)  # distance of unit vectors at the cosine asked for

    coded_type = T.StructType([T.StructField("id", T.LongType()), T.StructField("copies", T.LongType()),
                               T.StructField("list", T.IntegerType()), T.StructField("vec", T.BinaryType()),
                               T.StructField("code", T.BinaryType()), T.StructField("lost", T.DoubleType()),
                               T.StructField("probes", T.ArrayType(T.IntegerType())), T.StructField("mask", T.BinaryType())])

    def encode(batches):
        schema, ix = to_arrow_schema(coded_type), index.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x = _unit(_matrix(batch.column(2).to_pylist(), ix.dim))
                own, code, lost, probe = ix.encode(x, reach * d)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array([r.tobytes() for r in x]),
                     pa.array([r.tobytes() for r in code]), pa.array(lost),
                     pa.array([np.flatnonzero(r).tolist() for r in probe], pa.list_(pa.int32())),
                     pa.array([r.tobytes() for r in np.packbits(probe, axis=1)])], schema=schema)

    coded = materialize(nodes.mapInArrow(encode, coded_type), "coded")
    # Sizes of the lists and of their queries (bounded by the number of lists) give the blocks and parts.
    blocks = {r[0]: -(-r[1] // BLOCK) for r in coded.groupBy("list").count().collect()}
    asked = {r[0]: -(-r[1] // QUERIES) for r in coded.select(F.explode("probes").alias("l")).groupBy("l").count().collect()}
    number = lambda sizes, key: F.element_at(F.array(*[F.lit(sizes.get(i, 0)) for i in range(count)]), F.col(key) + 1)
    salt = lambda key, sizes, word: F.pmod(F.xxhash64(F.lit(word), "id"), F.greatest(F.lit(1), number(sizes, key))).cast("int")
    upto = lambda sizes, key: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), number(sizes, key)) - 1))
    held = coded.select("list", salt("list", blocks, "b").alias("block"), upto(asked, "list").alias("part"),
                        F.lit(0).alias("kind"), "id", "copies", "vec", "code", "lost", "mask", F.col("list").alias("own"))
    queries = coded.select("id", "copies", "vec", F.col("list").alias("own"), F.explode("probes").alias("list")).where(number(blocks, "list") > 0)
    queries = queries.select("list", upto(blocks, "list").alias("block"), salt("list", asked, "q").alias("part"), F.lit(1).alias("kind"),
                             "id", "copies", "vec", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("lost"),
                             F.lit(None).cast("binary").alias("mask"), "own")
    dealt = held.unionAll(queries).repartition("list", "block", "part").sortWithinPartitions("list", "block", "part", "kind")

    def search(batches):
        ix = index.value
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

        def compare(which, base, owed, ids, copies, q, own):
            """Counts of links of the queries, and edges to the smallest node each query or row reaches here.

            Rows whose own probes leave out the query's list do not find it themselves: their counts are added to ``owed``.
            """
            b_ids, b_copies, b_vec, b_code, b_lost, b_mask = base
            counts = np.zeros(len(ids), np.int64)
            found = []
            step = max(1, CELLS // max(1, len(b_ids)))
            within = ((d + b_lost + 1e-4) ** 2).astype(np.float32)
            for s in range(0, len(ids), step):
                near = ix.distances(q[s:s + step], which, b_code) <= within[:, None]
                j, i = np.nonzero(near)
                ok = np.concatenate([np.einsum("ij,ij->i", q[s + i[c:c + CELLS // 8]], b_vec[j[c:c + CELLS // 8]]) >= cosine
                                     for c in range(0, max(1, len(i)), CELLS // 8)])
                i, j = i[ok] + s, j[ok]
                other = ids[i] != b_ids[j]
                i, j = i[other], j[other]
                counts += np.bincount(i, b_copies[j], len(ids)).astype(np.int64)
                blind = (b_mask[j, own[i] >> 3] >> (7 - (own[i] & 7))) & 1 == 0
                owed += np.bincount(j[blind], copies[i[blind]], len(b_ids)).astype(np.int64)
                found.append((i, j))
            i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            names, node = np.unique(np.concatenate([ids[i], b_ids[j]]), return_inverse=True)
            root = _local_roots(node[:len(i)], node[len(i):], len(names))
            out = [(ids, counts, ids), (names, np.zeros(len(names), np.int64), names[root])]
            arrays = [np.concatenate([o[k] for o in out]) for k in range(3)]
            use = (arrays[1] > 0) | (arrays[0] != arrays[2])
            return pa.RecordBatch.from_arrays([pa.array(a[use]) for a in arrays], schema=schema)

        def counted(base, owed):
            at = np.flatnonzero(owed)
            return pa.RecordBatch.from_arrays([pa.array(a) for a in (base[0][0][at], owed[at], base[0][0][at])], schema=schema)

        key, base, owed = None, [], None
        for batch in batches:
            where = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            if not len(where):
                continue
            starts = np.flatnonzero(np.r_[True, (np.diff(where, axis=0) != 0).any(axis=1)])
            for a, b in zip(starts, np.append(starts[1:], len(where))):
                now, kind = tuple(where[a, :3]), where[a, 3]
                ids, copies = (batch.column(i).slice(a, b - a).to_numpy() for i in (4, 5))
                vec = np.frombuffer(b"".join(batch.column(6).slice(a, b - a).to_pylist()), float).reshape(b - a, ix.dim)
                if now != key:
                    if owed is not None:
                        yield counted(base, owed)
                    key, base, owed = now, [], None
                if kind == 0:
                    code = np.frombuffer(b"".join(batch.column(7).slice(a, b - a).to_pylist()), np.uint8)
                    mask = np.frombuffer(b"".join(batch.column(9).slice(a, b - a).to_pylist()), np.uint8)
                    base.append((ids, copies, vec, code.reshape(b - a, ix.parts), batch.column(8).slice(a, b - a).to_numpy(),
                                 mask.reshape(b - a, -1)))
                elif base:
                    if len(base) > 1:
                        base = [tuple(np.concatenate([x[i] for x in base]) for i in range(6))]
                    if owed is None:
                        owed = np.zeros(len(base[0][0]), np.int64)
                    yield compare(int(now[0]), base[0], owed, ids, copies, vec, batch.column(10).slice(a, b - a).to_numpy())
        if owed is not None:
            yield counted(base, owed)

    links = materialize(dealt.mapInArrow(search, "id long, n long, root long"), "links")
    cc = connected_components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    near = links.groupBy("id").agg(F.sum("n").alias("n"))
    named = nodes.join(near, "id", "left").join(cc, "id", "left").select(
        F.col("v").alias("_v"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    out = rows.where("_ok").join(named, "_v").select(F.col("_id").alias(id_col), "n_links", "component_id",
                                                     (F.col("_id") == F.col("component_id")).alias("kept"))
    return out.unionAll(rest)
