"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

The best segmentation of a pre-token into vocabulary pieces has the largest sum of piece scores
(fewest pieces among equal sums). The forward score of a prefix depends on that prefix alone, so the
distinct pre-tokens of a slice of texts form a trie and each node is scored once for all words that
share the prefix; the count at a word's last node is kept. A text's count is the sum over its pre-tokens.

The trie is held as the sorted words: a node of some depth is a stretch of neighbours that agree so far.
All nodes of one depth are scored at once by numpy from the nodes above them: each hands down the starts
from which a piece still goes on, with the place in the trie of pieces and the score at the start.
Nothing is shuffled; counts of words seen before are remembered per worker, in two generations (bounded;
changes cost only).

Scores follow from the rank of a piece in a public vocabulary file by Zipf's law: the integer nearest
to -1e6 * ln(rank + 2.7). Integers make ties exact. All 256 bytes are pieces, so every text has a
segmentation. Defined results: null and empty texts have no pre-tokens and no tokens.
"""

from __future__ import annotations

import base64
import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from revline.llm.bpe import Splitter
from revline.llm.common import append_columns

MEMO_WORDS = 300_000  # words of each of two generations remembered per worker
TRIE_BYTES = 512      # a longer pre-token gets its forward scores alone: a trie would share nothing
NONE = -(1 << 61)     # no piece ends here


class Pieces:
    """The trie of pieces as a hash table from (state, byte) to state; state 0 is the root."""

    def __init__(self, score: dict[bytes, int]):
        states: dict[int, int] = {}
        value, parents = [NONE], set()
        for piece, s in score.items():
            at = 0
            for b in piece:
                key = at << 8 | b
                parents.add(at)
                at = states.setdefault(key, len(value))
                if at == len(value):
                    value.append(NONE)
            # ordered by score, then by fewer pieces: sums of such numbers hold the number of pieces in their low bits
            value[at] = (s << 24) - 1
        self.value = np.array(value, np.int64)
        self.goes_on = np.zeros(len(value), bool)
        self.goes_on[list(parents)] = True
        keys = np.array(list(states), np.int64)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.full(1 << self.bits, -1, np.int64)
        todo, slot, to = keys, self._slot(keys), np.array(list(states.values()), np.int64)
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = todo[free]  # of several for one slot the last stays
            mine = self.keys[slot] == todo
            self.to[slot[mine]] = to[mine]
            todo, to, slot = todo[~mine], to[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The state after a byte (-1: no piece goes on so)."""
        key = state << 8 | byte
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.to[slot], -1)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... counts[i] numbers for each i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


class Unigram:
    def __init__(self, path: str):
        self.score: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    piece, rank = line.split()
                    self.score[base64.b64decode(piece)] = -round(1e6 * math.log(int(rank) + 2.7))
        self.longest = max(map(len, self.score))
        self.pieces = Pieces(self.score)
        self.split = Splitter()
        self.memo: dict[str, int] = {}
        self.old_memo: dict[str, int] = {}

    def count_words(self, words) -> dict[str, int]:
        """Token count of each distinct pre-token."""
        pairs = sorted((w.encode(), w) for w in words)
        counts = {w: self._alone(raw) for raw, w in pairs if len(raw) > TRIE_BYTES}
        pairs = [p for p in pairs if len(p[0]) <= TRIE_BYTES]
        if pairs:
            counts.update(zip([w for _, w in pairs], self._trie([raw for raw, _ in pairs]).tolist()))
        return counts

    def _trie(self, words: list[bytes]) -> np.ndarray:
        pieces = self.pieces
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        offset = np.cumsum(size) - size
        out = np.zeros(len(words), np.int64)
        # the node above each word still going on, and for each such node its open starts: state of the piece, score at the start
        rows = np.flatnonzero(size > 0)
        above = np.zeros(len(rows), np.int64)
        first, many = np.array([0]), np.array([1])
        state, score = np.array([0]), np.array([0])
        depth = 0
        while len(rows):
            byte = flat[offset[rows] + depth]
            depth += 1
            head = np.ones(len(rows), bool)
            head[1:] = (above[1:] != above[:-1]) | (byte[1:] != byte[:-1])
            node = np.cumsum(head) - 1
            parent, letter = above[head], byte[head]
            take = _ragged(first[parent], many[parent])
            owner = np.repeat(np.arange(len(parent)), many[parent])
            to = pieces.step(state[take], letter[owner])
            alive = to >= 0
            owner, to, base = owner[alive], to[alive], score[take[alive]]
            # every byte is a piece, so every node has a piece that ends here
            begin = np.searchsorted(owner, np.arange(len(parent)))
            best = np.maximum.reduceat(base + pieces.value[to], begin)
            done = size[rows] == depth
            out[rows[done]] = -best[node[done]] & 0xFFFFFF
            # hand down the starts that go on, and this node as a start
            on = pieces.goes_on[to]
            owner, to, base = owner[on], to[on], base[on]
            many = np.bincount(owner, minlength=len(parent)) + 1
            first = np.cumsum(many) - many
            state, score = np.zeros(many.sum(), np.int64), np.repeat(best, many)
            place = np.arange(len(owner)) + owner
            state[place], score[place] = to, base
            rows, above = rows[~done], node[~done]
        return out

    def _alone(self, raw: bytes) -> int:
        """The forward scores of one long pre-token, keeping only the last ``longest`` of them."""
        score, longest = self.score.get, self.longest
        best = [(0, 0)]
        for end in range(1, len(raw) + 1):
            n = len(best)
            top = None
            for back in range(1, n + 1):
                s = score(raw[end - back:end])
                if s is not None:
                    before = best[n - back]
                    x = (before[0] + s, before[1] - 1)
                    if top is None or x > top:
                        top = x
            best.append(top)
            if len(best) > longest:
                del best[0]
        return -best[-1][1]

    def count_texts(self, texts) -> tuple[list[int], list[int]]:
        """Numbers of pre-tokens and of tokens of each text."""
        split = [self.split(t) if t else [] for t in texts]
        memo, old = self.memo, self.old_memo
        missing = set().union(*split).difference(memo)
        new = missing.difference(old)
        memo.update((w, old[w]) for w in missing.difference(new))
        memo.update(self.count_words(new))
        known = memo.__getitem__
        out = [len(w) for w in split], [sum(map(known, w)) for w in split]
        if len(memo) > MEMO_WORDS:
            self.memo, self.old_memo = {}, {w: n for w, n in memo.items() if len(w) <= TRIE_BYTES}
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    return Unigram(path)


RESULT = T.StructType([T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])


def token_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the numbers of pre-tokens and tokens of each whole text."""
    return append_columns(docs, text_col, RESULT, lambda: load(path).count_texts)
