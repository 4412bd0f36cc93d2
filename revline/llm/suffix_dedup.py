"""Removal of long repeated passages with an enhanced suffix array and its common-prefix intervals.

A byte is removed if a string of ``length`` bytes (default 100) that covers it also starts earlier: in a
document of smaller id, or earlier in the same one. Whole texts are compared as UTF-8 bytes, strings never
cross documents, and all are judged on the input.

1. Anchors. Of the 32-byte grams of every 100-byte window the one with the smallest hash is its anchor, a
   function of the window's content: equal windows have equal anchors at equal offsets. Neighbouring windows
   with one anchor form a piece, so a text is cut into about one piece for each 35 bytes, and any repeated
   string can be found among pieces of one anchor hash (a class).
2. Equal pieces (128 bits of hash) repeat as wholes: all but the first are covered. This is settled inside a
   slice of documents before the shuffle, so a hot passage sends one row for each slice, and then by a scan
   over rows sorted by (anchor, piece), which holds one row of a class at a time.
3. Classes with several different pieces get a suffix array. Its suffixes start where two pieces of the class
   cease to agree to the left of the anchor (elsewhere a repeat can be extended and is not maximal). Sorted
   with their common-prefix lengths, a stack scan yields the tree of common-prefix intervals; an interval of
   at least ``length`` bytes whose members differ to the left is a maximal repeat group. Each member is
   reported once, at the deepest group where it is not the first, so all occurrences are told in linear space.
4. Classes of more than ``CLASS_ROWS`` different pieces (one frequent line with ever different surroundings)
   are not held: their windows are grouped by content with partial aggregates instead, exactly.

Defined results: a null or empty text has no bytes; a row with a null id stays whole and matches nothing; rows
that repeat an id count as one document with its smallest text, and rows with another text stay whole.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revline.llm.common import fresh, slices_by_bytes
from revline.session import materialize

GRAM = 32
CHUNK = 1 << 21        # bytes of text handled at once
POSITION = 23          # bits of a position in a chunk
CLASS_ROWS = 4_096     # different pieces of a class that one suffix array holds

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    size = CHUNK + 4096
    return tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, b, _U)]), dtype=_U)
                 for b in (base, pow(base, -1, 1 << 64)))


def _pieces(buf: bytes, starts: np.ndarray, sizes: np.ndarray, length: int):
    """Pieces of the texts in a buffer: (text number, start in it, size, offset of the anchor, anchor hash, piece hash)."""
    n = len(buf)
    raw = np.frombuffer(buf + b"\0" * 64, np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw[:n + 32 + 7], 8)).view(_U).ravel()
    words = _mix(words)
    gram = words[:n] * _U(0x9E3779B97F4A7C15)
    for k, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        gram += words[k:n + k] * _U(c)
    gram = _mix(gram)
    low = (gram >> _U(POSITION) << _U(POSITION)) | np.arange(n, dtype=_U)
    width, covered = length - GRAM + 1, 1
    while covered * 2 <= width:
        low = np.minimum(low[:-covered], low[covered:])
        covered *= 2
    if covered < width:
        low = np.minimum(low[:len(low) - (width - covered)], low[width - covered:])
    # windows inside one text
    edge = np.zeros(n + 2, np.int8)
    has = sizes >= length
    edge[starts[has]] += 1
    edge[starts[has] + sizes[has] - length + 1] -= 1
    inside = np.cumsum(edge)[:len(low)] > 0
    anchor = (low & _U((1 << POSITION) - 1)).astype(np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(first)
    if not len(begin):
        return None
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    size = np.flatnonzero(last) - begin + length
    power, inverse = _powers()
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(words[:n] * power[:n], dtype=_U)])
    piece = _mix((sums[begin + size - 7] - sums[begin]) * inverse[begin])
    text = np.searchsorted(starts, begin, side="right") - 1
    at = anchor[begin]
    return text, begin - starts[text], size, at - begin, gram[at].view(np.int64), piece


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of spans, by document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    new = np.r_[True, doc[1:] != doc[:-1]]
    group = np.cumsum(new)
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


# A row is a piece, or (negative ``end``) a covered span whose first occurrence is at ``anchor``, ``what``. For a
# piece, ``what`` packs 48 bits of its hash, its size beyond the shortest and the offset of its anchor, so equal
# pieces have equal ``what``.
ROW = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("what", T.LongType()),
                    T.StructField("doc", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _batch(*columns):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=to_arrow_schema(ROW))


def _spans(doc, start, end, first_doc, first_start, groups: bool):
    """Covered spans: with their first occurrences, or merged."""
    if groups:
        return _batch(first_doc, first_start, doc, start, -end)
    doc, start, end = _merge(doc, start, end)
    none = np.zeros(len(doc), np.int64)
    return _batch(none, none, doc, start, -end)


def _cut(length: int, groups: bool):
    """Texts to pieces; repeats inside a slice are covered at once."""
    def slices(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.binary())
            sizes = pa.compute.binary_length(texts).to_numpy()
            for a, b in slices_by_bytes(sizes.tolist(), CHUNK):
                parts = texts.slice(a, b - a).to_pylist()
                if b - a > 1 or len(parts[0]) <= CHUNK:
                    yield ids[a:b], np.zeros(b - a, np.int64), parts
                else:  # windows of a very long text, by stretches
                    for s in range(0, len(parts[0]) - length + 1, CHUNK):
                        yield ids[a:b], np.array([s]), [parts[0][s:s + CHUNK + length - 1]]

    def run(batches):
        for ids, base, parts in slices(batches):
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            got = _pieces(b"".join(parts), np.cumsum(sizes) - sizes, sizes, length)
            if got is None:
                continue
            text, start, size, lead, anchor, piece = got
            what = (piece >> _U(16) << _U(16) | (size - length).astype(_U) << _U(8) | lead.astype(_U)).view(np.int64)
            doc, start = ids[text], start + base[text]
            order = np.lexsort((start, doc, what, anchor))
            anchor, what, doc, start, size = (x[order] for x in (anchor, what, doc, start, size))
            first = np.r_[True, (anchor[1:] != anchor[:-1]) | (what[1:] != what[:-1])]
            yield _batch(anchor[first], what[first], doc[first], start[first], start[first] + size[first])
            again = np.flatnonzero(~first)
            if len(again):
                of = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))[again]
                yield _spans(doc[again], start[again], start[again] + size[again], doc[of], start[of], groups)
    return run


def _scan(groups: bool):
    """Sorted pieces: covers repeats of equal pieces, and passes on the first of each in classes that have several."""
    def run(batches):
        # the class and piece so far, the piece's first place, and the class's row while it has one piece only
        held_anchor = held_what = held_first = held_only = None
        for batch in batches:
            covers = pa.compute.less(batch.column(4), 0)
            if (plain := batch.filter(covers)).num_rows:
                yield plain
            batch = batch.filter(pa.compute.invert(covers))
            if not batch.num_rows:
                continue
            anchor, what, doc, start, end = (batch.column(i).to_numpy() for i in range(5))
            new_class = np.r_[held_anchor is None or anchor[0] != held_anchor, anchor[1:] != anchor[:-1]]
            new_piece = new_class | np.r_[held_what is None or what[0] != held_what, what[1:] != what[:-1]]
            group = np.cumsum(new_class) - int(new_class[0])  # 0: the first class here, perhaps the held one
            goes_on = not new_class[0]
            several = np.bincount(group, new_piece)
            if goes_on:
                several[0] += 1
                if held_only is not None and several[0] > 1:
                    yield _batch(*[np.array([x]) for x in held_only])
                    held_only = None
            at = np.maximum.accumulate(np.where(new_piece, np.arange(len(what)), -1))
            first_doc = np.where(at >= 0, doc[at], held_first[0] if held_first else 0)
            first_start = np.where(at >= 0, start[at], held_first[1] if held_first else 0)
            again = ~new_piece
            if again.any():
                yield _spans(doc[again], start[again], end[again], first_doc[again], first_start[again], groups)
            use = new_piece & (several[group] > 1)
            if use.any():
                yield _batch(anchor[use], what[use], doc[use], start[use], end[use])
            if several[group[-1]] > 1:
                held_only = None
            elif group[-1] or not goes_on:
                k = np.flatnonzero(new_class)[-1]
                held_only = (anchor[k], what[k], doc[k], start[k], end[k])
            held_anchor, held_what, held_first = anchor[-1], what[-1], (first_doc[-1], first_start[-1])
    return run


def _words(rows: list[bytes], width: int) -> np.ndarray:
    """Byte strings as rows of big-endian words, filled with zero bytes; these sort as the strings do."""
    joined = b"".join([r.ljust(width, b"\0") for r in rows])
    return np.frombuffer(joined, ">u8").reshape(len(rows), width // 8)


def _order(words: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    return np.lexsort((sizes, *[words[:, k] for k in range(words.shape[1] - 1, -1, -1)], group))


def _common(words: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it (0 for the first, and across groups)."""
    raw = words.view(np.uint8).reshape(len(words), -1)
    differ = raw[1:] != raw[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), raw.shape[1])
    same = np.minimum(np.minimum(same, sizes[1:]), sizes[:-1])
    same[group[1:] != group[:-1]] = 0
    return np.r_[0, same]


def interval_tree(common: np.ndarray, before: np.ndarray, rank: np.ndarray, length: int):
    """Stack scan of an enhanced suffix array for its maximal repeat groups.

    ``common``: common prefix of each suffix with the one before it; ``before``: the byte to its left (negative:
    the text begins); ``rank``: order of the occurrences. Yields (member, depth, first): every member of a group
    of at least ``length`` bytes, at the deepest group where it is not the first. An interval whose members all
    have the same byte to the left is no maximal repeat; its members are told by the group of the longer string.
    """
    depth = np.where(common >= length, common, 0)
    after = np.r_[depth[1:], 0]
    byte, order = before.tolist(), rank.tolist()
    stack: list[list] = []  # open intervals, outer first: depth, common byte to the left or -1, members
    for i in np.flatnonzero((depth > 0) | (after > 0)).tolist():
        left, members, d = byte[i], [i], int(after[i])
        while stack and stack[-1][0] > d:
            top = stack.pop()
            left = left if left == top[1] else -1
            members += top[2]
            first = min(members, key=order.__getitem__)
            if left < 0:
                for m in members:
                    if m != first:
                        yield m, top[0], first
            members = [first]
        if stack and stack[-1][0] == d:
            top = stack[-1]
            top[1] = top[1] if top[1] == left else -1
            top[2] += members
        elif d:
            stack.append([d, left, members])


CONTEXT = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("doc", T.LongType()),
                        T.StructField("start", T.LongType()), T.StructField("lead", T.LongType()),
                        T.StructField("data", T.BinaryType())])


def _fetch(batches):
    """Bytes of the pieces asked for, from whole texts."""
    schema = to_arrow_schema(CONTEXT)
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            docs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            out = [(w["anchor"], doc, w["start"], w["what"] & 255, text[w["start"]:w["end"]])
                   for doc, text, wanted in zip(docs, texts, batch.column(2).to_pylist()) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _repeat_groups(length: int, groups: bool):
    """Sorted pieces of classes to covered spans, by the suffix array of each class."""
    def solve(anchor, doc, start, lead, data):
        size = np.fromiter(map(len, data), np.int64, len(data))
        cls = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]]) - 1
        # Left of the anchor: where neighbours in the order of reversed left contexts cease to agree.
        words = _words([d[:k][::-1] for d, k in zip(data, lead.tolist())], -(-max(1, length - GRAM) // 8) * 8)
        order = _order(words, lead, cls)
        common = _common(words[order], lead[order], cls[order])
        pair = np.r_[False, cls[order][1:] == cls[order][:-1]]
        at = np.unique(cls[order][pair] * 256 + common[pair])
        # Suffixes of the class that begin there.
        low, high = np.searchsorted(cls, at >> 8), np.searchsorted(cls, at >> 8, side="right")
        count = high - low
        piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
        back, key = np.repeat(at & 255, count), np.repeat(at, count)
        skip = lead[piece] - back
        use = (skip >= 0) & (size[piece] - skip >= length)
        piece, key, skip = piece[use], key[use], skip[use]
        if not len(piece):
            return None
        words = _words([data[p][k:] for p, k in zip(piece.tolist(), skip.tolist())], -(-(2 * length - GRAM) // 8) * 8)
        sizes = size[piece] - skip
        order = _order(words, sizes, key)
        piece, skip = piece[order], skip[order]
        common = _common(words[order], sizes[order], key[order])
        before = np.array([data[p][k - 1] if k else -1 for p, k in zip(piece.tolist(), skip.tolist())], np.int64)
        place = start[piece] + skip
        rank = np.empty(len(piece), np.int64)
        rank[np.lexsort((place, doc[piece]))] = np.arange(len(piece))
        told = list(interval_tree(common, before, rank, length))
        if not told:
            return None
        member, depth, first = (np.array(x) for x in zip(*told))
        return _spans(doc[piece][member], place[member], place[member] + depth, doc[piece][first], place[first], groups)

    def run(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            anchor = rest.column(0).to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            if cut:
                if (out := solved(rest.slice(0, cut))) is not None:
                    yield out
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows and (out := solved(rest)) is not None:
            yield out

    def solved(batch):
        return solve(*(batch.column(i).to_numpy() for i in range(4)), batch.column(4).to_pylist())

    return run


WINDOW = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc", T.LongType()), T.StructField("start", T.LongType())])


def _windows(length: int):
    """Every window of a piece by the digest of its content, for classes too large for one suffix array."""
    def run(batches):
        schema = to_arrow_schema(WINDOW)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                out = [(xxhash.xxh3_128_digest(d[i:i + length]), doc, s + i)
                       for doc, s, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist())
                       for i in range(len(d) - length + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


def _one_per_id(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(id, text) with one row for each id, and whether any id repeats."""
    docs = docs.where("_id IS NOT NULL")
    if docs.groupBy("_id").count().where("count > 1").isEmpty():
        return docs, False
    return docs.groupBy("_id").agg(F.min("_text").alias("_text")), True


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def _covered(texts: DataFrame, length: int, groups: bool, class_rows: int) -> DataFrame:
    """Covered spans (doc, start, end, first_doc, first_start) of unique, non-null ids."""
    if not GRAM <= length < GRAM + 256:
        raise ValueError(f"length must be {GRAM} to {GRAM + 255}")
    rows = texts.mapInArrow(_cut(length, groups), ROW)
    deal = F.when(F.col("end") < 0, F.col("doc")).otherwise(F.col("anchor"))
    rows = rows.repartition(deal).sortWithinPartitions(F.col("end") < 0, "anchor", "what", "doc", "start")
    rows = materialize(rows.mapInArrow(_scan(groups), ROW), "pieces")
    wanted = rows.where("end > 0")
    large = wanted.groupBy("anchor").count().where(F.col("count") > class_rows).select("anchor")
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "what", "start", "end")).alias("wanted"))
    pieces = texts.join(lists, texts["_id"] == lists["doc"]).select("doc", "_text", "wanted").mapInArrow(_fetch, CONTEXT)
    out = [rows.where("end < 0").select("doc", "start", (-F.col("end")).alias("end"), F.col("anchor").alias("first_doc"),
                                        F.col("what").alias("first_start"))]
    if not large.isEmpty():
        windows = pieces.join(large, "anchor", "left_semi").select("anchor", "doc", "start", "lead", "data") \
            .mapInArrow(_windows(length), WINDOW)
        firsts = windows.groupBy("key").agg(F.min(F.struct("doc", "start")).alias("first"))
        out.append(windows.join(firsts, "key").where(F.struct("doc", "start") != F.col("first")).select(
            "doc", "start", (F.col("start") + length).alias("end"), "first.doc", "first.start")
            .toDF("doc", "start", "end", "first_doc", "first_start"))
        pieces = pieces.join(large, "anchor", "left_anti").select("anchor", "doc", "start", "lead", "data")
    solved = pieces.repartition("anchor").sortWithinPartitions("anchor", "doc", "start").mapInArrow(_repeat_groups(length, groups), ROW)
    out.append(solved.select("doc", "start", (-F.col("end")).alias("end"), F.col("anchor").alias("first_doc"),
                             F.col("what").alias("first_start")))
    result = out[0]
    for part in out[1:]:
        result = result.unionAll(part)
    return result


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
            class_rows: int = CLASS_ROWS) -> DataFrame:
    """(doc, start, end, first_doc, first_start): occurrences of repeat groups, each with the group's first.

    Rows of one first place and size are one group; the first occurrence itself has no row. Long repeats
    are told by overlapping groups of at most ``2 * length - 32`` bytes.
    """
    texts, _ = _one_per_id(_texts(docs, id_col, text_col))
    return _covered(texts, length, True, class_rows)


def _without(text: bytes, spans, whole_characters: bool):
    """(kept bytes, removed bytes, removed runs) of one text."""
    runs: list[list[int]] = []
    for a, b in sorted(spans or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    if whole_characters:  # a run gives back bytes of characters that it holds in part
        inner = []
        for a, b in runs:
            while a < len(text) and text[a] & 0xC0 == 0x80:
                a += 1
            while b < len(text) and text[b] & 0xC0 == 0x80:
                b -= 1
            if a < b:
                inner.append([a, b])
        runs = inner
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), sum(b - a for a, b in runs), len(runs)


def _joined(docs: DataFrame, id_col: str, text_col: str, length: int, class_rows: int, spans_col: str) -> DataFrame:
    """``docs`` with the covered spans of each row."""
    key, digest = fresh(docs.columns, "_id"), fresh(docs.columns, "_digest")
    texts, repeated = _one_per_id(_texts(docs, id_col, text_col))
    spans = _covered(texts, length, False, class_rows).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias(spans_col))
    spans = spans.withColumnRenamed("doc", key)
    on = [key]
    with_key = docs.withColumn(key, F.col(id_col).cast("long"))
    if repeated:  # spans hold for the rows with the text that was matched
        spans = spans.join(texts.select(F.col("_id").alias(key), F.xxhash64("_text").alias(digest)), key)
        with_key = with_key.withColumn(digest, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
        on.append(digest)
    found = with_key.where(F.col(key).isNotNull()).join(spans, on, "left").select(*docs.columns, spans_col)
    none = docs.where(F.col(id_col).cast("long").isNull()).withColumn(spans_col, F.lit(None).cast(spans.schema[spans_col].dataType))
    return found.unionByName(none)


DIGEST = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                       T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
            class_rows: int = CLASS_ROWS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = _joined(docs.select(id_col, text_col), id_col, text_col, length, class_rows, "_spans")
    out = T.StructType([rows.schema[id_col], *DIGEST.fields])

    def run(batches):
        schema = to_arrow_schema(out)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                result = []
                for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                    kept, removed, n = _without(text or b"", [(s["start"], s["end"]) for s in spans or ()], False)
                    result.append((len(text or b""), removed, n, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, schema.field(i + 1).type) for i, c in enumerate(zip(*result))]], schema=schema)

    return rows.mapInArrow(run, out)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
           class_rows: int = CLASS_ROWS) -> DataFrame:
    """``docs`` with repeated passages cut from its text, at whole characters; all rows and columns stay."""
    spans_col = fresh(docs.columns, "_spans")
    rows = _joined(docs, id_col, text_col, length, class_rows, spans_col)
    out = docs.schema

    def run(batches):
        schema = to_arrow_schema(out)
        where = schema.get_field_index(text_col)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                spans = batch.column(batch.num_columns - 1)
                texts = batch.column(where)
                if spans.null_count < len(spans):
                    raw = zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist())
                    texts = pa.array([None if t is None else _without(t, [(s["start"], s["end"]) for s in found or ()], True)[0]
                                      for t, found in raw], pa.binary()).cast(pa.string())
                arrays = [texts if i == where else batch.column(i) for i in range(len(schema))]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return rows.mapInArrow(run, out)
