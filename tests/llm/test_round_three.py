"""Digests, hard negatives, periodic runs, the array trie and result names, against plain re-computations."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revline.llm import bpe, crf_langid, hard_negatives, periodic_runs, quartile_digest, queries, simhash, token_counts
from test_operators import BPE_PATH, DOCS, ODD, RANK_PATH, best_count, empty, odd_docs, sample_texts


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


# ---- digests --------------------------------------------------------------------------------------

def plain_digest(text):
    raw, n = text.encode(), quartile_digest.BUCKETS
    counts, padded = [0] * n, b"\0\0" + text.encode()
    for i in range(len(raw)):
        v = padded[i] | padded[i + 1] << 8 | padded[i + 2] << 16
        counts[(v * 0x9E3779B1 % 2 ** 32) >> (32 - int(math.log2(n)))] += 1
    up = sorted(counts)
    cuts = [up[n * q // 4 - 1] for q in (1, 2, 3)]
    return min(255, int(8 * math.log2(1 + len(raw)))), [sum(c > x for x in cuts) for c in counts]


def plain_likeness(a, b):
    length = min(abs(a[0] - b[0]), quartile_digest.LENGTH_BOUND)
    return 1 - (sum(abs(x - y) for x, y in zip(a[1], b[1])) + length) / (sum(map(max, zip(a[1], b[1]))) + quartile_digest.LENGTH_BOUND)


def plain_hex(d):
    return bytes([d[0], *[sum(c << 2 * k for k, c in enumerate(d[1][i:i + 4])) for i in range(0, len(d[1]), 4)]]).hex()


def test_digests_equal_a_plain_count(spark, tmpdir_path):
    texts = ODD + [t for _, t in sample_texts(40)] + ["x", "é" * 7, "same", "same"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "no id"), (9, "a repeated id"), (9, "a repeated id")]
    table(spark, tmpdir_path, "documents", rows, "doc_id long, text string")
    got = queries.QUERIES["op11_quartile_digest"](spark, tmpdir_path).collect()
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    # rows of one id are ordered by a hash of the text: take what follows from the result's own likeness
    after = ordered[1:] + ordered[:1]
    want = {}
    for (has, i, t), (_, j, n) in zip(ordered, after):
        if i == 9 or j == 9:
            continue
        e, d = t[:len(t) - len(t) // 2] + n[:len(t) // 2], plain_digest(t)
        want[i if has else None] = (len(t), hashlib.sha256(e.encode()).hexdigest(), plain_hex(d), plain_hex(plain_digest(e)),
                                    plain_likeness(d, plain_digest(e)), plain_likeness(d, plain_digest(n)))
    by = {r.doc_id: tuple(r)[1:] for r in got}
    assert len(got) == len(rows) and len(want) > 50
    for i, w in want.items():
        assert by[i][:4] == w[:4] and np.allclose(by[i][4:], w[4:])
    assert len({r.fingerprint for r in got if r.doc_id in (None,)}) == 1
    assert len({r.fingerprint for r in got if r.n_chars == 4}) == 1  # equal texts
    one = quartile_digest.edit_likeness(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert quartile_digest.edit_likeness(empty(spark)).count() == 0


def test_fingerprints_and_their_likeness(spark):
    df = quartile_digest.fingerprints(odd_docs(spark).withColumn("fingerprint", F.lit("clash")))
    assert df.columns[-1] == "fingerprint_" and df.count() == len(ODD) + 2
    pairs = df.select("doc_id", F.col("fingerprint_").alias("a")).withColumn("b", F.when(F.col("doc_id") == 5, F.lit(None)).otherwise(F.col("a")))
    rows = pairs.select("doc_id", quartile_digest.likeness_column("a", "b").alias("l")).collect()
    assert {r.l for r in rows if r.doc_id != 5} == {1.0} and {r.l for r in rows if r.doc_id == 5} == {None}


def test_edits_are_nearer_than_neighbours(spark):
    found = queries.QUERIES["op11_quartile_digest"](spark, "/root/testdata/sf0.01")
    r = found.agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("double")), F.min("near_next"), F.max("near_edited")).first()
    assert r[0] > 0.98 and r[1] >= 0 and r[2] <= 1


# ---- hard negatives -------------------------------------------------------------------------------

def plain_negatives(rows):
    """Every pair scored; rows with an id that repeats are told by their vector."""
    clean = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * x) for x in v))
             for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, v in clean:
        if i % 50:
            continue
        scored = sorted((-dot(v, w), j, m) for j, m, w in clean if j != i)
        for s, j, _ in [x for x in scored if x[2] == lab][:5]:
            kept = [(t, k) for t, k, m in scored if m != lab and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(kept)]
    return sorted(out)


def vectors(rng, n, dims=40):
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]


def test_negatives_equal_every_pair(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP", 100)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = vectors(np.random.default_rng(2), 420)
    rows += [(500 + k, 1, rows[50][2]) for k in range(4)] + [(600 + k, k % 3, rows[100][2]) for k in range(5)]  # copies: ties
    rows += [(700, 1, None), (701, None, rows[1][2]), (702, 1, [float("nan")] * 40), (703, 1, [None] + [0.1] * 39), (704, 2, [0.0] * 40),
             (705, 1, rows[50][2][:7]), (706, 1, []), (None, 1, rows[2][2]), (750, 1, [0.0] * 40), (708, 0, [1e30] + [0.0] * 39)]
    rows += [rows[3], rows[50], (60, 2, rows[61][2])]  # repeated rows, an id with two vectors
    table(spark, tmpdir_path, "embeddings", rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in queries.QUERIES["op12_hard_negatives"](spark, tmpdir_path).collect())
    assert got == plain_negatives([r for r in rows if r[0] != 708]) and len(got) > 50


def test_negatives_of_odd_tables(spark, tmpdir_path):
    schema = "vec_id long, label int, embedding array<float>"
    for n, rows in enumerate([[], [(50, 1, [0.5, 0.5])], [(50, 1, [0.5]), (51, 1, [0.5])], [(50, 1, None)]]):
        table(spark, f"{tmpdir_path}/{n}", "embeddings", rows, schema)
        assert queries.QUERIES["op12_hard_negatives"](spark, f"{tmpdir_path}/{n}").count() == 0
    clash = spark.createDataFrame([(50, 1, [9, 9], 1), (51, 1, [9, 8], 1), (52, 2, [5, 5], 1)], "vec_id long, label int, vector array<int>, _g int")
    assert hard_negatives.mine(clash, F.col("vec_id") == 50).collect() == [(50, 1, 51, 1, 52, 153, 90)]


def test_intervals_hold_every_score():
    rng = np.random.default_rng(5)
    for scale, dims in ((256, 64), (3, 64), (60_000, 128)):
        x = np.floor(rng.normal(size=(300, dims)) * scale).astype(np.int64)
        x[0] = 0
        wide = []
        for layers in (1, 3, 6):
            low, high = hard_negatives.Codes(x, layers).bounds(x[:20], slice(0, 300))
            true = x[:20] @ x.T
            assert (low <= true).all() and (true <= high).all()
            wide.append(np.mean(high - low))
        assert wide[2] < wide[1] < wide[0]


# ---- periodic runs --------------------------------------------------------------------------------

def plain_runs(w, exponent=4, least=6):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            part = w[s:s + n]
            if n >= max(least, exponent * q) and not any(all(part[k] == part[k + p] for k in range(n - p)) for p in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 10)])
def test_runs_equal_a_plain_scan(exponent, least):
    rng = random.Random(exponent)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 6)):
            k, w = rng.choice([1, 2, 3, 8]), []
            while len(w) < rng.randint(0, 70):
                unit = [str(rng.randint(0, k)) for _ in range(rng.randint(1, 6))]
                w += unit * rng.randint(1, 6) + unit[:rng.randint(0, len(unit))]
            texts.append(w)
        assert periodic_runs.runs(texts, exponent, least) == [plain_runs(w, exponent, least) for w in texts]


def test_runs_of_a_long_periodic_text():
    word = periodic_runs.runs([["a"] * 60_000, ["b", "c", "d"] * 15_000], 4, 6)
    assert word == [[(0, 60_000, 1)], [(0, 45_000, 3)]]


def plain_op13(i, text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    if i is not None:
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = plain_runs(w)
    drop = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in drop).encode()).hexdigest())


def test_runs_query_equals_a_plain_scan(spark, tmpdir_path):
    texts = [t for t in ODD] + [t[:1500] for _, t in sample_texts(150)] + ["la " * 9 + "end", "a b " * 4, "a b " * 3 + "a", "\x1cx\x1cx " * 8, "x　x " * 7]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, "no no no no no no id")]
    table(spark, tmpdir_path, "documents", rows, "doc_id long, text string")
    got = queries.QUERIES["op13_periodic_runs"](spark, tmpdir_path).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *plain_op13(i, t))) for i, t in rows)
    assert sum(r.n_runs > 0 for r in got) > 10
    clash = odd_docs(spark).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("c"))
    out = periodic_runs.periodic_runs(clash)
    assert out.columns[-3:] == ["n_words", "runs_", "collapsed_"] and out.count() == clash.count()
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0


# ---- token counts ---------------------------------------------------------------------------------

def test_trie_counts_equal_the_plain_recurrence(monkeypatch):
    model, rng = token_counts.Unigram(RANK_PATH), random.Random(3)
    words = set().union(*[model.split(t) for _, t in sample_texts(40)]) | {"é" * k for k in range(1, 9)} | {"\0", "\U0001F600" * 3}
    words |= {"".join(rng.choices("abcdeth", k=rng.randint(1, 40))) for _ in range(300)}
    long = {"x" * 511, "x" * 512, "x" * 513, "the" * 400, "é" * 300}
    got = model.count_words(words | long)
    assert all(got[w] == best_count(w.encode(), model.score) for w in words | long)
    texts = [t for _, t in sample_texts(30)] + ["y" * 6000 + " " + "ab " * 3000, "", None]
    whole = model.count_texts(texts)
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 50)  # two generations of remembered words
    small = token_counts.Unigram(RANK_PATH)
    assert [small.count_texts([t]) for t in texts] == [([n], [c]) for n, c in zip(*whole)] and len(small.old_memo) > 0
    assert whole[0] == [len(bpe.load(BPE_PATH).split(t)) if t else 0 for t in texts]


# ---- result names ---------------------------------------------------------------------------------

TAKEN = ["n_tokens", "ids_sha256", "decoded_sha256", "n_pretokens", "position", "block", "slot", "on_target", "fp", "component_id", "N_Tokens_"]


def test_result_names_never_clash(spark):
    docs = odd_docs(spark)
    for name in TAKEN:
        docs = docs.withColumn(name, F.lit("taken"))
    n = docs.count()
    for out in (bpe.round_trip(docs, BPE_PATH), token_counts.token_counts(docs, RANK_PATH), crf_langid.identify(docs, training=docs)):
        assert out.count() == n and len({c.lower() for c in out.columns}) == len(out.columns) and out.where("n_tokens = 'taken'").count() == n
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        rows = out.collect()
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
        assert name == "bpe_encode_decode" and len(rows) == n or out.columns == docs.columns and rows


# ---- large SimHash groups -------------------------------------------------------------------------

def test_large_groups_lose_no_link(spark, monkeypatch):
    rng, mask = random.Random(7), (1 << 64) - 1
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = set(base)
    for b in base:  # many near each other: they share the keys of many tables
        for _ in range(250):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(f - (1 << 63) for f in fps)

    def parts(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {f: find(f) for f in fps}
    want = parts((a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) & mask).bit_count() <= 3)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert parts(simhash.links(df).collect()) == want
    # cut by further bits: in this process, so that the smaller bound holds
    monkeypatch.setattr(simhash, "LARGE_GROUP", 5)
    bits = np.array(fps, np.int64).view(np.uint64)
    pivots = np.bitwise_count(bits[:, None] ^ np.array(simhash.PIVOTS, np.int64).view(np.uint64)[None]).astype(np.int16)
    edges = simhash._large_group_edges(bits, pivots, 3)
    assert parts((int(a), int(b)) for x, y in edges for a, b in zip(x.view(np.int64), y.view(np.int64))) == want
