"""Hard-negative mining with rotated one-bit codes.

Scores are inner products of integer vectors. A vector is turned by a fixed random rotation and described by
``layers`` one-bit codes: the signs of what earlier layers left, with the stored alignment of code and vector
(their inner product) and the exact length of the last remainder. An anchor is turned the same way and cut in 8
bit planes, so its inner product with a code is a few popcounts. With x = sum of alignment * code + remainder,

    | <anchor, x> - estimate |  <=  |anchor off the last code| * |remainder|  +  |cut error| * |coded part|

by Cauchy-Schwarz (the remainder is orthogonal to the last code), so every score lies in a known interval. Rows
whose interval cannot reach the best k are left out; the others are scored in integers. Nothing is estimated in
the result: it equals a full scan.

Rows are dealt to groups of about ``GROUP`` by a hash; a group is held in codes and the anchors stream past, a
few at a time. Each group gives at most k rows for each anchor (and positive), merged by a ranking. The work is
anchors times rows, in blocks; nothing is broadcast, and no group grows with the data.

Defined results: rows with a null label, id or vector, or a null component, or one of 2**24 and more in absolute
value (products would leave 64 bits) take no part; vectors of unequal length compare as if filled with zeros;
rows equal in id, label and vector are one row; other rows of the anchor's id are neither its positives nor its
negatives; ties go to the smaller id, then to the smaller label; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revline.session import materialize

GROUP = 4096    # rows held in codes at once
ANCHORS = 32    # anchors scored against a group at once
PLANES = 8      # bits an anchor's component is cut to
LARGEST = 1 << 24


@functools.lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation; the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(20240).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of a group of integer vectors, in the order given."""

    def __init__(self, vectors: np.ndarray, layers: int):
        n, self.dims = vectors.shape
        self.vectors = vectors
        rest = vectors.astype(float) @ rotation(self.dims)
        self.bits, self.align = [], []
        for _ in range(layers):
            sign = rest >= 0
            align = np.abs(rest).sum(1) / np.sqrt(self.dims)
            rest = rest - (align / np.sqrt(self.dims))[:, None] * np.where(sign, 1.0, -1.0)
            self.bits.append(np.packbits(sign, axis=1, bitorder="little").view(np.uint64))
            self.align.append(align)
        self.rest = np.sqrt((rest * rest).sum(1))
        size = np.sqrt((vectors.astype(float) ** 2).sum(1))
        self.coded = size + self.rest
        self.slack = 1e-9 * (size + 1)

    def bounds(self, anchors: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible score of each anchor with each row of the slice."""
        turned = anchors.astype(float) @ rotation(self.dims)
        low = turned.min(1, keepdims=True)
        step = np.maximum(turned.max(1, keepdims=True) - low, 1e-300) / (2 ** PLANES - 1)
        cut = np.rint((turned - low) / step).astype(np.uint8)
        error = np.sqrt(((turned - low - cut * step) ** 2).sum(1))
        total = (cut.astype(float) * step + low).sum(1)
        planes = [np.packbits(cut >> p & 1, axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)]
        estimate, dot = 0.0, None
        for bits, align in zip(self.bits, self.align):
            code = bits[rows]
            inside = np.zeros((len(anchors), len(code)))
            for word in range(code.shape[1]):
                for p, plane in enumerate(planes):
                    inside += np.bitwise_count(plane[:, word, None] & code[None, :, word]) * float(1 << p)
            ones = sum(np.bitwise_count(code[:, w]) for w in range(code.shape[1])).astype(float)
            # the sum of the anchor over the code's ones, twice, less its whole sum: its product with the signs
            dot = (2 * (inside * step + low * ones) - total[:, None]) / np.sqrt(self.dims)
            estimate = estimate + align[rows] * dot
        size = np.sqrt((turned ** 2).sum(1))
        # dot is that of the cut anchor: the true one is off by at most the cut error
        off = np.sqrt(np.maximum(size[:, None] ** 2 - np.maximum(np.abs(dot) - error[:, None], 0) ** 2, 0))
        reach = off * self.rest[rows] + error[:, None] * self.coded[rows] + size[:, None] * self.slack[rows] + 1e-6
        return estimate - reach, estimate + reach

    def scores(self, anchors: np.ndarray, a: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", anchors[a], self.vectors[rows])


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row of a matrix (-inf where it has fewer)."""
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def best(k: int, group: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Indexes of the first k rows of each group by score, then id."""
    order = np.lexsort((ids, -scores, group))
    g = group[order]
    first = np.searchsorted(g, g)
    return order[np.arange(len(g)) - first < k]


class Group:
    """The rows of one group, sorted by label."""

    def __init__(self, ids, labels, vectors, layers):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.codes = Codes(vectors[order], layers)

    def positives(self, ids, labels, vectors, k: int):
        """(anchor, id, label, score) of the first k rows with the anchor's label."""
        out = []
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            a, b = np.searchsorted(self.labels, [label, label + 1])
            for s in range(0, len(mine), ANCHORS) if a < b else ():
                at = mine[s:s + ANCHORS]
                low, high = self.codes.bounds(vectors[at], slice(a, b))
                other = self.ids[a:b][None] != ids[at][:, None]
                enough = kth_largest(np.where(other, low, -np.inf), k)
                i, r = np.nonzero(other & (high >= enough[:, None]))
                r += a
                score = self.codes.scores(vectors[at], i, r)
                keep = best(k, i, self.ids[r], score)
                out.append((at[i[keep]], self.ids[r[keep]], self.labels[r[keep]], score[keep]))
        return out

    def negatives(self, ids, labels, vectors, floors, tops, k: int):
        """(anchor, place of the positive, id, label, score) of the first k rows of other labels in each range."""
        out, every = [], slice(0, len(self.ids))
        for s in range(0, len(ids), ANCHORS):
            at = np.arange(s, min(s + ANCHORS, len(ids)))
            low, high = self.codes.bounds(vectors[at], every)
            other = (self.labels[None] != labels[at][:, None]) & (self.ids[None] != ids[at][:, None])
            for j in range(floors.shape[1]):
                floor, top = floors[at, j, None], tops[at, j, None]
                can = other & (high >= floor) & (low <= top)
                sure = np.where(other & (low >= floor) & (high <= top), low, -np.inf)
                can &= high >= kth_largest(sure, k)[:, None]
                i, r = np.nonzero(can)
                score = self.codes.scores(vectors[at], i, r)
                inside = (score >= floors[at[i], j]) & (score <= tops[at[i], j])
                i, r, score = i[inside], r[inside], score[inside]
                keep = best(k, i, self.ids[r], score)
                out.append((at[i[keep]], np.full(len(keep), j), self.ids[r[keep]], self.labels[r[keep]], score[keep]))
        return out


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _search(dims: int, layers: int, out: T.StructType, answer):
    """Hold the rows (kind 0) of one group after another and answer the anchors (kind 1) that follow them."""
    def run(batches):
        schema = to_arrow_schema(out)
        number, held, group = None, [], None
        for batch in batches:
            g, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero(np.diff(g) | np.diff(kind)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(g)]):
                if a == b:
                    continue
                if g[a] != number:
                    number, held, group = g[a], [], None
                part = batch.slice(a, b - a)
                ids, labels = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                vectors = _matrix(part.column(4), np.int32, dims).astype(np.int64)
                if kind[a] == 0:
                    held.append((ids, labels, vectors))
                    continue
                if group is None and held:
                    group = Group(*[np.concatenate(x) for x in zip(*held)], layers)
                for found in answer(group, part, ids, labels, vectors) if group else ():
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays(
                            [(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(found, schema)], schema=schema)
    return run


def _packed(rows: DataFrame, vec_col: str, width: int) -> DataFrame:
    """Vectors as 4-byte integers filled with zeros to ``width`` numbers."""
    kept = [f for f in rows.schema.fields if f.name != vec_col]
    out = T.StructType([*kept, T.StructField("_vec", T.BinaryType())])

    def run(batches):
        schema = to_arrow_schema(out)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(vec_col))
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            x = np.zeros((len(sizes), width), np.int32)
            x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            cols = [batch.column(batch.schema.get_field_index(f.name)).cast(schema.field(i).type) for i, f in enumerate(kept)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([v.tobytes() for v in x], pa.binary())], schema=schema)

    return rows.mapInArrow(run, out)


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "vector",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, layers: int = 6) -> DataFrame:
    """Hard negatives of the anchors among ``rows``, whose vectors are arrays of integers.

    For each anchor (a row for which ``anchors`` holds) and each of its first ``positives`` rows of the same label,
    the first ``negatives`` rows of another label with low * positive_score <= 100 * negative_score <= high *
    positive_score: (anchor_id, anchor_label, positive_id, rank, negative_id, positive_score, negative_score).
    """
    whole = ~F.exists(vec_col, lambda x: x.isNull() | (x >= LARGEST) | (x <= -LARGEST))
    clean = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & whole) \
        .select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"),
                F.col(vec_col).cast("array<int>").alias("_x"), F.coalesce(anchors, F.lit(False)).alias("_anchor")).distinct()
    width = clean.agg(F.max(F.size("_x"))).first()[0] or 1
    width = -(-width // 64) * 64
    coded = materialize(_packed(clean, "_x", width), "negatives-rows")
    n = coded.count()
    groups = max(1, -(-n // GROUP))
    # rows in groups by a hash; anchors once for each group
    dealt = coded.select(F.pmod(F.xxhash64("_id", "_label", "_vec"), F.lit(groups)).cast("int").alias("_g"), F.lit(0).alias("_kind"),
                         "_id", "_label", "_vec", F.lit(None).cast("array<struct<id:bigint,label:bigint,score:bigint>>").alias("_pos"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g")
    asked = coded.where("_anchor").select("_id", "_label", "_vec")

    def meet(questions: DataFrame, out: str, answer) -> DataFrame:
        schema = T._parse_datatype_string(out)
        both = dealt.unionByName(questions.select(numbers, F.lit(1).alias("_kind"), "_id", "_label", "_vec", "_pos"))
        return both.repartitionById(groups, F.col("_g")).sortWithinPartitions("_g", "_kind") \
            .mapInArrow(_search(width, layers, schema, answer), schema)

    def with_positives(group, part, ids, labels, vectors):
        return [(ids[a], labels[a], part.column(4).take(pa.array(a)), *found) for a, *found in group.positives(ids, labels, vectors, positives)]

    near = meet(asked.withColumn("_pos", F.lit(None).cast(dealt.schema["_pos"].dataType)),
                "_id long, _label long, _vec binary, id long, label long, score long", with_positives)
    anchor = ["_id", "_label", "_vec"]
    first = Window.partitionBy(*anchor).orderBy(F.desc("score"), "id", "label")
    near = near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= positives)
    known = materialize(near.groupBy(*anchor).agg(F.array_sort(F.collect_list(F.struct("id", "label", "score"))).alias("_pos")), "negatives-known")

    def with_negatives(group, part, ids, labels, vectors):
        lists = part.column(5)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        most = int(sizes.max())
        at = (np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        score = np.zeros((len(sizes), most), np.int64)
        pos_id = np.zeros((len(sizes), most), np.int64)
        score[at], pos_id[at] = flat.field("score").to_numpy(), flat.field("id").to_numpy()
        floors, tops = -(-low * score // 100), high * score // 100
        floors[np.arange(most)[None] >= sizes[:, None]] = 1 << 62  # no such positive: an empty range
        return [(ids[a], labels[a], part.column(4).take(pa.array(a)), j, pos_id[a, j], score[a, j], *found)
                for a, j, *found in group.negatives(ids, labels, vectors, floors, tops, negatives)]

    far = meet(known, "_id long, _label long, _vec binary, j int, positive_id long, positive_score long, id long, label long, score long", with_negatives)
    order = Window.partitionBy(*anchor, "j").orderBy(F.desc("score"), "id", "label")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives) \
        .select(F.col("_id").alias("anchor_id"), F.col("_label").alias("anchor_label"), "positive_id", "rank",
                F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
