"""Document fingerprints: quartile bucket digests.

Every byte of a text ends one triplet (the first two bytes are taken as following two zero bytes). Triplets are
hashed to ``BUCKETS`` buckets and counted; the three quartiles of the counts cut the buckets in four classes of
two bits. A digest is the length on a logarithmic scale (one byte) and the classes, in hex. Two digests differ by
the sum of the class differences and the bounded length difference, as a share of the largest possible such sum
for these two; likeness is one less that share. Counts of a slice of texts are taken at once by numpy.

Defined results: a null text is an empty text; its digest is all zeros; digests of equal texts are equal and their
likeness is 1; likeness is between 0 and 1 and the same both ways; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revline.llm.common import append_columns, map_with_next

BUCKETS = 1024
LENGTH_BOUND = 16  # an eighth of a doubling is a step of length; two doublings and more count alike

_CLASSES = np.array([[x >> s & 3 for s in (0, 2, 4, 6)] for x in range(256)], np.int16)  # the four classes in a byte


def _counts(texts: list[bytes]) -> np.ndarray:
    """Triplets of each text by bucket."""
    joined = np.frombuffer(b"\0\0" + b"\0\0".join(texts), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.sum():
        return np.zeros((len(texts), BUCKETS), np.int64)
    value = joined[:-2] | joined[1:-1] << np.uint32(8) | joined[2:] << np.uint32(16)
    bucket = (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    # the triplet that starts at k ends at k + 2: of text i are those from its first byte less two on, one for each byte
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.repeat(np.cumsum(sizes + 2) - sizes - 2, sizes) + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.bincount(owner * BUCKETS + bucket[starts], minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)


def digests(texts: list[bytes]) -> np.ndarray:
    """One row of bytes for each text: length, then four bucket classes a byte."""
    if not texts:
        return np.zeros((0, 1 + BUCKETS // 4), np.uint8)
    counts = _counts(texts)
    order = np.partition(counts, [BUCKETS * q // 4 - 1 for q in (1, 2, 3)], axis=1)
    classes = sum((counts > order[:, BUCKETS * q // 4 - 1, None]).astype(np.uint8) for q in (1, 2, 3))
    body = (classes.reshape(len(texts), -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(2, dtype=np.uint8)
    length = [min(255, int(8 * np.log2(1 + len(t)))) for t in texts]
    return np.concatenate([np.array(length, np.uint8)[:, None], body], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness (0 to 1) of the digests of two tables, row by row."""
    n = len(a)
    x, y = (_CLASSES[d[:, 1:]].reshape(n, -1) for d in (a, b))
    length = np.minimum(np.abs(a[:, 0].astype(int) - b[:, 0]), LENGTH_BOUND)
    return 1 - (np.abs(x - y).sum(1) + length) / (np.maximum(x, y).sum(1) + LENGTH_BOUND)


def _hex(d: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in d]


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", drop_text: bool = True) -> DataFrame:
    """``docs`` with the digest of each whole text (without the text, unless told otherwise)."""
    def make():
        return lambda texts: [_hex(digests([(t or "").encode() for t in texts]))]

    return append_columns(docs, text_col, T.StructType([T.StructField(out, T.StringType())]), make, drop_text)


def likeness_column(a: str, b: str) -> Column:
    """Likeness of two digest columns (null if one is)."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        both = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        if both.any():
            u, v = (np.frombuffer(bytes.fromhex("".join(s[both])), np.uint8).reshape(both.sum(), -1) for s in (x, y))
            out[both] = likeness(u, v)
        return pd.Series(out).astype(object).where(both, None)

    return run(F.col(a), F.col(b))


EDITED = T.StructType([
    T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.BinaryType()),
    T.StructField("fingerprint", T.BinaryType()), T.StructField("edited_fingerprint", T.BinaryType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How digests follow an edit: for each row its digest, that of its text with the last half of its characters
    replaced by as many (or all) of the next row's, and its likeness to that and to the next row's.

    The next row is that with the next larger (id, text); the first row follows the last. Null ids come first.
    """
    def make():
        def f(texts):
            here, after = texts[:-1], texts[1:]
            edited = [(t[:len(t) - len(t) // 2] + n[:len(t) // 2]).encode() for t, n in zip(here, after)]
            own, new = digests([t.encode() for t in texts]), digests(edited)
            return [[len(t) for t in here], [hashlib.sha256(e).digest() for e in edited],
                    [d.tobytes() for d in own[:-1]], [d.tobytes() for d in new],
                    likeness(own[:-1], new), likeness(own[:-1], own[1:])]
        return f

    found = map_with_next(docs, id_col, text_col, EDITED, make)
    return found.select(*[F.lower(F.hex(c)).alias(c) if t == "binary" and c != id_col else F.col(c) for c, t in found.dtypes])
