"""BPE encoding and decoding with a contiguous rank array per short word.

A pre-token is held as one array of part ids and one array of the ranks of adjacent parts. The
smallest rank is found by a scan, its boundary is deleted, and the two neighbouring ranks are looked
up again. Pre-tokens longer than ``SCAN_LIMIT`` bytes use a heap over the same merges (same result:
lowest rank first, then leftmost). Merges and vocabulary come from a public tokenizer file whose
path is a parameter.

Defined results: a null text is an empty text; an empty text has no tokens; the decoded text of whole
input is the input; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import sys
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from revline.llm.common import append_columns

SCAN_LIMIT = 128       # bytes of a word up to which the rank array is scanned
MEMO_WORDS = 300_000   # words of each of two generations remembered per worker; changes cost only
NONE = 1 << 60

# The split pattern of the byte-level tokenizer files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters and numbers of Unicode versions after the one the public tokenizer library
# knows (16). It takes them for other signs, the regex module for letters and numbers.
LATER = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A"
    r"\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686"
    r"\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    r"\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128"
    r"\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF"
    r"\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4"
    r"\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable bytes stand for
    themselves, the others take code points from 256 up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """Cuts a text to pre-tokens as the tokenizers library does."""

    def __init__(self):
        self.plain = regex.compile(PATTERN).findall
        self.later = np.zeros(sys.maxunicode + 1, bool)
        for first, last in regex.findall(r"(\\u.{4}|\\U.{8})(?:-(\\u.{4}|\\U.{8}))?", LATER):
            self.later[int(first[2:], 16):int((last or first)[2:], 16) + 1] = True
        letter, number, other = f"(?![{LATER}])\\p{{L}}", f"(?![{LATER}])\\p{{N}}", f"[^\\s\\p{{L}}\\p{{N}}]|[{LATER}]"
        self.careful = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?(?:{letter})+| ?(?:{number})+| ?(?:{other})+|\\s+(?!\\S)|\\s+").findall

    def __call__(self, text: str) -> list[str]:
        if not text.isascii() and self.later[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return self.careful(text)
        return self.plain(text)


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = raw(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        one = {raw(t): i for t, i in vocab.items() if len(t) == 1}
        self.first = [one[bytes([b])] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[left] * self.size + vocab[right], r)
            self.merged.append(vocab[left + right])
        self.digits = [str(i) for i in range(self.size)]
        self.split = Splitter()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.memo: dict[str, bytes] = {}
        self.old_memo: dict[str, bytes] = {}

    def word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.first[b] for b in word]
        if len(ids) > SCAN_LIMIT:
            return self._long_word(ids)
        n, rank = self.size, self.rank.get
        ranks = [rank(x * n + y, NONE) for x, y in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i] = self.merged[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] * n + ids[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(ids[i] * n + ids[i + 1], NONE)
        return ids

    def _long_word(self, ids: list[int]) -> list[int]:
        """The same merges for a long pre-token, with a heap and links instead of a scan."""
        n, rank, end = self.size, self.rank.get, len(ids)
        after, before = [*range(1, end + 1)], [*range(-1, end - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(end - 1)
                if (r := rank(ids[i] * n + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= end or ids[j] != y:
                continue  # one side was merged meanwhile
            ids[i], ids[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < end and (q := rank(ids[a] * n + ids[b])) is not None:
                    heapq.heappush(heap, (q, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def _remembered(self, token: str) -> bytes:
        """Ids of a pre-token that the young generation lacks; a full one becomes the old one."""
        got = self.old_memo.get(token)
        if got is None:
            got = array("i", self.word(token.encode())).tobytes()
        if len(token) <= SCAN_LIMIT:
            if len(self.memo) >= MEMO_WORDS:
                self.old_memo = dict(self.memo)
                self.memo.clear()
            self.memo[token] = got
        return got

    def _plain(self, text: str) -> list[bytes]:
        known, look = self.memo.get, self._remembered
        return [known(token) or look(token) for token in self.split(text)]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of the special tokens become their ids."""
        if self.cut is None or not any(s in text for s in self.special):
            parts = self._plain(text)
        else:
            parts = []
            for piece in self.cut.split(text):
                if piece in self.special:
                    parts.append(array("i", [self.special[piece]]).tobytes())
                elif piece:
                    parts += self._plain(piece)
        return array("i", b"".join(parts)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


RESULT = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def encode_ids(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` without its text, with the token ids of each text as an array column."""
    def make():
        bpe = load(path)
        return lambda texts: [[bpe.encode(t or "") for t in texts]]

    return append_columns(docs, text_col, T.StructType([T.StructField(out, T.ArrayType(T.IntegerType()))]), make)


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with token count, digest of the ids and digest of the decoded text.

    The digests are taken in the task, so the ids of a text never leave its worker.
    """
    def make():
        bpe = load(path)
        digit = bpe.digits.__getitem__

        def f(texts):
            n, a, b = [], [], []
            for t in texts:
                ids = bpe.encode(t or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(digit, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return [n, a, b]
        return f

    return append_columns(docs, text_col, RESULT, make)
