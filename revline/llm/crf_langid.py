"""Language identification of words and documents with a linear-chain conditional random field.

Every word of a text is labelled with a language. Emission features of a word are byte n-grams of the
lower-cased word with boundary marks, its prefixes and suffixes (affixes), and membership in a lexicon
of frequent training words; transitions between neighbouring labels are learned as well, from sequences
that switch between languages at random points. Labels' marginal probabilities come from
forward-backward over each line (lines are cut every ``MAX_STEP`` words). A document's language is the
label with the largest sum of marginals over all its words (ties: the smallest label), its score that
sum divided by the number of words.

The field is fitted on a bounded sample: at most about ``docs_per_lang`` documents of each language, each
of at most ``max_chars`` characters, chosen by a hash of the id. Everything else covers whole texts.

Defined results: a text that is null or has no letter gets ``und`` with score 0; with no labelled rows
every text does. Repeated rows give repeated results; other columns pass through.
"""

from __future__ import annotations

import re


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revline.llm.common import append_columns

UNKNOWN = "und"
MAX_STEP = 128        # words of a sequence
BITS = 14             # hashed features of each kind: 2 ** BITS
MEMO_WORDS = 80_000   # words remembered per worker; changes cost only
KINDS = 5             # 2-, 3- and 4-byte n-grams, prefixes, suffixes

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

_TOKEN = re.compile(r"[^\W\d_]+|\n")


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all words one after the other, and where each word's begin."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(b"".join(raw) + b"\x00" * 4, np.uint8).astype(np.uint32)
    ends = np.cumsum(lens)
    starts = ends - lens
    word_of = np.repeat(np.arange(len(raw)), lens)
    pos = np.arange(int(ends[-1])) if len(raw) else np.zeros(0, np.int64)
    left = ends[word_of] - pos if len(raw) else pos  # bytes from here to the end of the word

    def slot(key, kind):
        key = (key ^ np.uint32(0x9E3779B1 * (kind + 1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        key ^= key >> np.uint32(15)
        key *= np.uint32(0xC2B2AE35)
        return (key >> np.uint32(32 - BITS)).astype(np.int64) + (kind << BITS)

    n = len(pos)
    g2 = buf[:n] | buf[1:n + 1] << np.uint32(8)
    g3 = g2 | buf[2:n + 2] << np.uint32(16)
    g4 = g3 | buf[3:n + 3] << np.uint32(24)
    ids, owner = [], []
    for kind, (size, key) in enumerate(((2, g2), (3, g3), (4, g4))):
        keep = left >= size
        ids.append(slot(key[keep], kind))
        owner.append(word_of[keep])
    for size, key in ((3, g3), (4, g4)):  # affixes: with their boundary mark
        keep = lens >= size
        who = np.flatnonzero(keep)
        ids.append(slot(key[starts[keep]], 3))
        owner.append(who)
        ids.append(slot(key[ends[keep] - size], 4))
        owner.append(who)
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(raw)))


def _marginals(emit: np.ndarray, starts: np.ndarray, lens: np.ndarray, trans: np.ndarray,
               want_pairs: bool = False):
    """Label probabilities of each word, by forward-backward over sequences side by side.

    ``emit``: word scores, sequences one after the other. Also the expected transition counts.
    """
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    steps = int(lens[0]) if len(lens) else 0
    active = np.searchsorted(-lens, -np.arange(steps), side="left")  # sequences longer than t
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    a = np.exp(trans)
    alpha = np.empty_like(e)
    prev = None
    for t in range(steps):
        at = starts[:active[t]] + t
        f = e[at] if prev is None else (prev[:active[t]] @ a) * e[at]
        f /= f.sum(axis=1, keepdims=True)
        alpha[at] = prev = f
    out = alpha.copy()
    pairs = np.zeros_like(a)
    beta = np.ones((0, e.shape[1]))
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        full = np.ones((n, e.shape[1]))
        full[:len(beta)] = beta
        right = full * e[starts[:n] + t + 1]
        beta = right @ a.T
        at = starts[:n] + t
        p = alpha[at] * beta
        total = p.sum(axis=1, keepdims=True)
        if want_pairs:
            pairs += a * (alpha[at].T @ (right / total))
        out[at] = p / total
        beta /= beta.sum(axis=1, keepdims=True)
    return (out, pairs) if want_pairs else out


class Crf:
    """Fitted weights; a plain picklable object of fixed size."""

    def __init__(self, labels: list[str], weights, lexicon: dict[str, int], lex_weights, trans):
        self.labels, self.weights, self.lexicon = labels, weights, lexicon
        self.lex_weights, self.trans = lex_weights, trans

    def emissions(self, words: list[str]) -> np.ndarray:
        ids, starts = _features(words)
        e = np.add.reduceat(self.weights[ids], starts, axis=0) if len(words) else np.zeros((0, len(self.labels)))
        known = self.lexicon.get
        lex = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        hit = lex >= 0
        e[hit] += self.lex_weights[lex[hit]]
        return e


def fit(samples: list[tuple[str, str]], lexicon_size: int = 1500, rounds: int = 40, seed: int = 7) -> Crf | None:
    """Fit on (language, text) pairs, by gradient steps on the conditional log-likelihood."""
    rng = np.random.default_rng(seed)
    by_lang: dict[str, list[list[str]]] = {}
    for lang, text in samples:
        words = [w for w in _TOKEN.findall(text.lower()) if w != "\n" and any(map(str.isalpha, w))]
        if words:
            by_lang.setdefault(lang, []).append(words)
    if not by_lang:
        return None
    labels = sorted(by_lang)
    runs = []  # stretches of one language
    lexicon: dict[str, int] = {}
    for k, lang in enumerate(labels):
        counts: dict[str, int] = {}
        for words in by_lang[lang]:
            at = 0
            while at < len(words):
                n = int(rng.integers(8, 64))
                runs.append((k, words[at:at + n]))
                at += n
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        for w in sorted(counts, key=lambda w: (-counts[w], w))[:lexicon_size]:
            lexicon.setdefault(w, len(lexicon))
    # Code-switched sequences: one to four stretches of any languages, one after the other.
    order = rng.permutation(len(runs))
    words, gold, lens, at = [], [], [], 0
    while at < len(order):
        n = int(rng.integers(1, 5))
        size = 0
        for r in order[at:at + n]:
            k, run = runs[r]
            words += run
            gold += [k] * len(run)
            size += len(run)
        lens.append(size)
        at += n
    types = {w: i for i, w in enumerate(dict.fromkeys(words))}
    seq = np.fromiter(map(types.__getitem__, words), np.int64, len(words))
    gold, lens = np.array(gold), np.array(lens)
    starts = np.cumsum(lens) - lens
    m, size = len(labels), KINDS << BITS
    ids, first = _features(list(types))
    owner = np.repeat(np.arange(len(types)), np.diff(np.append(first, len(ids))))
    lex = np.fromiter((lexicon.get(w, -1) for w in types), np.int64, len(types))
    hit = np.flatnonzero(lex >= 0)
    params = [np.zeros((size, m)), np.zeros((len(lexicon), m)), np.zeros((m, m))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    inside = np.ones(len(seq), bool)
    inside[starts] = False
    follow = np.flatnonzero(inside)
    seen = np.zeros((m, m))
    np.add.at(seen, (gold[follow - 1], gold[follow]), 1)
    for step in range(1, rounds + 1):
        w, lw, tr = params
        scores = np.add.reduceat(w[ids], first, axis=0)
        scores[hit] += lw[lex[hit]]
        prob, pairs = _marginals(scores[seq], starts, lens, tr, want_pairs=True)
        prob[np.arange(len(seq)), gold] -= 1
        by_type = np.stack([np.bincount(seq, prob[:, k], len(types)) for k in range(m)], 1)
        grad_w = np.stack([np.bincount(ids, by_type[owner, k], size) for k in range(m)], 1)
        grad_l = np.zeros_like(lw)
        grad_l[lex[hit]] = by_type[hit]
        n = len(seq)
        for p, g, (a, b), ridge in zip(params, (grad_w / n, grad_l / n, (pairs - seen) / n), moments, (1e-5, 1e-5, 1e-4)):
            g = g + ridge * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= 0.15 * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-9)
    return Crf(labels, params[0].astype(np.float32), lexicon, params[1].astype(np.float32), params[2])


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int,
                    max_chars: int) -> list[tuple[str, str]]:
    """(language, text) of a bounded sample, chosen by a hash of the id at a rate per language.

    A text longer than ``max_chars`` lends one stretch of that size, at a place given by another hash of the id (from
    its first letter on if that stretch has none).
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    span = 1 << 30
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(span, span * docs_per_lang // n))])
    drawn = F.pmod(F.xxhash64(F.lit("crf"), F.col(id_col)), F.lit(span))
    text, size = F.col(text_col), F.lit(max_chars)
    at = F.pmod(F.xxhash64(F.lit("stretch"), F.col(id_col)), F.length(text) - size + 1).cast("int")
    stretch = text.substr(at + 1, size)
    letter = F.length(F.regexp_extract(text, r"^\P{L}*+", 0)) + 1
    part = F.when(F.length(text) <= size, text).when(stretch.rlike(r"\p{L}"), stretch).otherwise(text.substr(letter, size))
    # A hash draw near the bound, then the bound itself: never more than the stated number.
    found = rows.where(drawn < rate[F.col(lang_col)]).select(id_col, lang_col, part.alias(text_col)) \
        .orderBy(drawn, id_col, text_col).limit(2 * docs_per_lang * len(counts)).collect()
    return [(r[1], r[2]) for r in sorted(found, key=lambda r: (r[1], r[0], r[2]))]


def _labeller(model: Crf | None):
    """A function from texts to [languages, scores]."""
    if model is None:
        return lambda texts: [[UNKNOWN] * len(texts), [0.0] * len(texts)]
    m = len(model.labels)
    index: dict[str, int] = {"\n": -1}
    table = [np.zeros((0, m))]

    def words_of(tokens: set[str]) -> None:
        new = sorted(tokens - index.keys())
        real = []
        for w in new:
            if any(map(str.isalpha, w)):
                real.append(w)
            else:
                index[w] = -1  # numerals that are no letters
        n = len(table[0])
        index.update(zip(real, range(n, n + len(real))))
        if real:
            table[0] = np.concatenate([table[0], model.emissions(real)])

    def f(texts):
        split = [_TOKEN.findall(t.lower()) if t else [] for t in texts]
        if len(index) > MEMO_WORDS:
            index.clear()
            index["\n"] = -1
            table[0] = np.zeros((0, m))
        words_of(set().union(*split))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter((index[w] for words in split for w in words), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(split)), sizes)
        real = np.flatnonzero(ids >= 0)
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not len(real):
            return [langs, scores]
        # A sequence ends at a line end, a document end, and after MAX_STEP words.
        breaks = np.cumsum(ids < 0)[real] + doc[real] * np.int64(len(ids) + 1)
        begin = np.flatnonzero(np.diff(breaks, prepend=breaks[0] - 1))
        within = np.arange(len(real)) - np.repeat(begin, np.diff(np.append(begin, len(real))))
        starts = np.flatnonzero(within % MAX_STEP == 0)
        lens = np.diff(np.append(starts, len(real)))
        prob = _marginals(table[0][ids[real]], starts, lens, model.trans)
        owner = doc[real]
        sums = np.stack([np.bincount(owner, prob[:, k], len(texts)) for k in range(m)], 1)
        n = np.bincount(owner, minlength=len(texts))
        best = sums.argmax(1)
        for i in np.flatnonzero(n):
            langs[i] = model.labels[best[i]]
            scores[i] = float(min(1.0, sums[i, best[i]] / n[i]))
        return [langs, scores]

    return f


def identify(docs: DataFrame, training: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", docs_per_lang: int = 150, max_chars: int = 20_000, keep_text: bool = False,
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with language and score, learned from ``training`` (``docs`` if not given)."""
    sample = training_sample(docs if training is None else training, id_col, text_col, lang_col, docs_per_lang, max_chars)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample))  # fixed size: hashed weights and a bounded lexicon
    new = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, RESULT)])
    return append_columns(docs, text_col, new, lambda: _labeller(model.value), drop_text=not keep_text, limit=1 << 20)
