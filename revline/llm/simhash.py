"""SimHash near-duplicates with pivot distance tables.

Every document gets a 64-bit fingerprint: the majority, bit by bit, of the XXH64 values (seed 42) of its
k-word shingles, repeats included. Fingerprints within ``max_bits`` differing bits are linked and a
component is named after its smallest id.

Equal fingerprints are one node. Candidates share three of six bit fields (with three differing bits, three
fields must be equal), one table per choice of fields. Each fingerprint carries a pivot table: its Hamming
distances to 16 reference fingerprints. Within a table's group, pairs whose largest coordinate difference
exceeds ``max_bits`` cannot be close (triangle inequality) and are discarded; survivors are verified by
counting bits. A group gives the edges of a spanning forest, never all its pairs.

Defined results: null and empty texts and texts without a word have fingerprint zero, linked like any
other; a row with a null id is fingerprinted, and names a component only if no row of it has an id (null);
repeated rows give repeated results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revline.llm.common import append_columns, connected_components, fresh
from revline.session import materialize

SEED = 42
FIELDS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]  # offset and width of the bit fields
PIVOTS = [xxhash.xxh64_intdigest(b"pivot %d" % i) - (1 << 63) for i in range(16)]
LARGE_GROUP = 4096  # members of one table key that are searched together; more are cut by further bits
BLOCK = 255  # rows whose bits sum without leaving a byte


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Fingerprint as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at \x20 and \x09-\x0D
    n = len(words) - words_per_shingle + 1
    digest = xxhash.xxh64_digest
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 0:
        hashes, n = digest(joined, SEED), 1
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[:n].tolist()
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_per_shingle - 1:].tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1)
    whole = n // BLOCK * BLOCK
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += np.add.reduce(bits[:whole].reshape(-1, BLOCK, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text_col: str = "text", words_per_shingle: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` without its text, with the fingerprint of each whole text (bigint)."""
    def make():
        return lambda texts: [[fingerprint(t, words_per_shingle) for t in texts]]

    return append_columns(docs, text_col, T.StructType([T.StructField(out, T.LongType())]), make, limit=8 << 20)


def _group_edges(fp: np.ndarray, table: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges of one group: each search step compares one member with those not reached yet."""
    out = []
    left, left_table = np.arange(len(fp)), table
    while len(left) > 1:
        root, front = left[0], [left[0]]
        left, left_table = left[1:], left_table[1:]
        while front and len(left):
            i = front.pop()
            # pivot coordinates first, then the bits of the survivors
            hit = np.abs(left_table - table[i]).max(axis=1) <= max_bits
            where = np.flatnonzero(hit)
            where = where[np.bitwise_count(fp[left[where]] ^ fp[i]) <= max_bits]
            if len(where):
                found = left[where]
                out.append((np.full(len(found), fp[root]), fp[found]))
                front.extend(found.tolist())
                rest = np.ones(len(left), bool)
                rest[where] = False
                left, left_table = left[rest], left_table[rest]
    return out


def _large_group_edges(fp: np.ndarray, table: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect the close members of a large group, without comparing all with all.

    The bits in which members differ are cut in six parts: two members within three bits agree in three parts at least,
    so every choice of three parts gives groups to search, and none of the links is lost."""
    free = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [b for b in range(64) if free >> b & 1]
    if len(fp) <= LARGE_GROUP or len(bits) <= 12:  # so few bits tell 4,096 members apart at most
        return _group_edges(fp, table, max_bits)
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(bits, 6)]
    out = []
    for three in combinations(parts, 3):
        key = fp & np.uint64(sum(three))
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.diff(key[order], prepend=~key[order[0]]))
        for s, n in zip(start, np.diff(np.append(start, len(key)))):
            if n > 1:
                at = order[s:s + n]
                out += _large_group_edges(fp[at], table[at], max_bits)
    return out


def _edges(max_bits: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def groups(key, fp, pivots):
        """Edges within equal keys of sorted arrays."""
        table = pivots.view(np.uint8).reshape(-1, 16).astype(np.int16)
        start = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        size = np.diff(np.append(start, len(key)))
        two = start[size == 2]
        near = (np.abs(table[two] - table[two + 1]).max(axis=1) <= max_bits) if len(two) else np.zeros(0, bool)
        two = two[near]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
        out = [(fp[two], fp[two + 1])]
        for s, n in zip(start[size > 2], size[size > 2]):
            out += _large_group_edges(fp[s:s + n], table[s:s + n], max_bits)
        a, b = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    def run(batches):
        rest = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            now = (cols[0], cols[1].view(np.uint64), np.stack(cols[2:], 1))
            if rest is not None:
                now = tuple(np.concatenate([x, y]) for x, y in zip(rest, now))
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if cut:
                yield groups(*(np.ascontiguousarray(x[:cut]) for x in now))
            rest = tuple(x[cut:].copy() for x in now)
        if rest is not None and len(rest[0]):
            yield groups(*(np.ascontiguousarray(x) for x in rest))

    return run


def links(fps: DataFrame, col: str = "fp", max_bits: int = 3) -> DataFrame:
    """(a, b): edges between distinct fingerprints that connect all that are within ``max_bits`` (at most 3)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the six bit fields cover up to three differing bits")
    fp = F.col(col)
    coordinate = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in PIVOTS]
    packed = []
    for half in (coordinate[:8], coordinate[8:]):
        x = half[0]
        for i, c in enumerate(half[1:], 1):
            x = x.bitwiseOR(F.shiftleft(c, 8 * i))
        packed.append(x)
    field = [F.shiftrightunsigned(fp, o).bitwiseAND(F.lit((1 << w) - 1)) for o, w in FIELDS]
    keys = []
    for t, three in enumerate(combinations(range(6), 3)):
        x = F.lit(t).cast("long")
        for i in three:
            x = F.shiftleft(x, FIELDS[i][1]).bitwiseOR(field[i])
        keys.append(x)
    rows = fps.select(col).distinct().select(F.col(col).alias("fp"), packed[0].alias("p1"), packed[1].alias("p2"),
                                             F.explode(F.array(*keys)).alias("key"))
    dealt = rows.select("key", "fp", "p1", "p2").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_edges(max_bits), "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3,
               max_bits: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``."""
    return _components(docs, id_col, text_col, words_per_shingle, max_bits).drop("component")


def _components(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int, max_bits: int) -> DataFrame:
    """(id, fp, component, component_id): ids that repeat can name two components, ``component`` tells them apart."""
    rows = materialize(fingerprints(docs.select(F.col(id_col), F.col(text_col)), text_col, words_per_shingle), "simhash")
    nodes = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    cc = connected_components(links(nodes, "fp", max_bits))
    named = nodes.join(cc.withColumnRenamed("id", "fp"), "fp", "left") \
        .select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "component").select("fp", "component", "component_id"), "fp") \
        .select(id_col, "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3,
             max_bits: int = 3) -> DataFrame:
    """``docs`` with one row for each component: that of the smallest id (of the smallest text where it repeats).

    Rows that repeat an id are told apart by their fingerprints. Rows with a null id stay.
    """
    found = _components(docs, id_col, text_col, words_per_shingle, max_bits).where(F.col(id_col).isNotNull())
    key, fp, seen, group = (fresh(docs.columns, n) for n in ("_keep", "_fp", "_seen", "_component"))
    lost = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(key)).distinct()
    again = found.groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias(key))
    if again.isEmpty():
        return docs.join(lost, F.col(id_col) == F.col(key), "left_anti")
    again = materialize(again, "again")
    once = docs.join(again, F.col(id_col) == F.col(key), "left_anti").join(lost, F.col(id_col) == F.col(key), "left_anti")
    # Only rows of repeated ids are fingerprinted again, with their texts.
    least = found.where(F.col(id_col) == F.col("component_id")) \
        .select(F.col(id_col).alias(key), F.col("fp").alias(fp), F.col("component").alias(group)).distinct()
    several = append_columns(docs.join(again, F.col(id_col) == F.col(key), "left_semi"), text_col,
                             T.StructType([T.StructField(seen, T.LongType())]),
                             lambda: lambda texts: [[fingerprint(t, words_per_shingle) for t in texts]], drop_text=False, limit=8 << 20)
    several = several.join(least, (F.col(id_col) == F.col(key)) & (F.col(seen) == F.col(fp)))
    first = several.groupBy(group).agg(F.min_by(F.struct(*docs.columns), F.struct(text_col)).alias(key))
    return once.unionByName(first.select(*[F.col(key)[n].alias(n) for n in docs.columns]))
