"""Operators against plain re-computations on small tables, with the odd cases each has to define."""

import hashlib
import itertools
import math
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from oracle_harness import compare, duck
from revline.llm import (bpe, crf_langid, decision_list, mixing, perspectives, pq_dedup, queries, rule_ensemble, simhash,
                         suffix_dedup, text_stats, token_counts)
from revline.llm.common import connected_components

BPE_PATH = public_tokenizers.path("byte_bpe_50k.json")
RANK_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string"
ODD = [None, "", " \n\t", "1234 5678", "a", "naïve Überraschung — 日本語 😀", "x" * 5000, "same words again " * 400,
       "one two three four five six", "one two three four five six", "line\nline\nother\n\nline", "\x00nul\x00byte <|endoftext|> end"]


def odd_docs(spark, texts=ODD):
    rows = [(i, t, ["en", None, "de"][i % 3], None if i % 4 == 0 else f"s{i % 3}", None, 0.5, "clash") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id here", "en", "s1", 3, None, None)]  # a repeated row, a null id
    return spark.createDataFrame(rows, DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def sample_texts(n=300):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_MID}/documents.parquet' ORDER BY doc_id LIMIT {n}").fetchall()
    return [(i, t) for i, t in rows]


# ---- BPE ----------------------------------------------------------------------------------------

def test_bpe_equals_tokenizers_library():
    from tokenizers import Tokenizer
    own, ref = bpe.load(BPE_PATH), Tokenizer.from_file(BPE_PATH)
    spaces = "".join(chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    texts = [t for t in ODD if t] + [spaces, "a b".join("\x1c\x1d\x85\xa0 　"), "'ll 'S don't",
                                         "new \U0002B73A't \U00011DE5\u0558's a\uA7D2b"] + [t for _, t in sample_texts(60)]
    for t in texts:
        ids = ref.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == ref.decode(ids, skip_special_tokens=False) == t


def test_bpe_long_words_same_by_scan_and_heap():
    own, rng = bpe.Bpe(BPE_PATH), random.Random(3)
    for _ in range(60):
        word = "".join(rng.choice("abelorstth") for _ in range(rng.randint(1, 120))).encode()
        assert own.word(word) == own._long_word([own.first[b] for b in word])


def test_bpe_rows(spark):
    rows = bpe.round_trip(odd_docs(spark), BPE_PATH).collect()
    assert len(rows) == len(ODD) + 2
    by = {r.doc_id: r for r in rows}
    assert by[0].n_tokens == by[1].n_tokens == 0 and by[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    for i, t in enumerate(ODD):
        assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(empty(spark), BPE_PATH).count() == 0
    assert bpe.encode_ids(odd_docs(spark), BPE_PATH).where("doc_id = 4").first().ids == [64]


# ---- token counts ---------------------------------------------------------------------------------

def best_count(raw: bytes, score: dict[bytes, int]) -> int:
    best = [(0, 0)]
    for end in range(1, len(raw) + 1):
        best.append(max((best[s][0] + score[raw[s:end]], best[s][1] - 1) for s in range(end) if raw[s:end] in score))
    return -best[-1][1]


def test_token_counts(spark):
    model = token_counts.Unigram(RANK_PATH)
    texts = [t for t in ODD if t] + [t for _, t in sample_texts(5)]
    split = regex.compile(bpe.PATTERN).findall
    expected = [(len(split(t)), sum(best_count(w.encode(), model.score) for w in split(t))) for t in texts if len(t) < 4000]
    assert list(zip(*model.count_texts([t for t in texts if len(t) < 4000]))) == expected
    assert model._alone(b"thoroughbred") == model.count_words({"thoroughbred"})["thoroughbred"]
    by = {r.doc_id: r for r in token_counts.token_counts(odd_docs(spark), RANK_PATH).collect()}
    assert by[0].n_tokens == by[1].n_pretokens == 0
    assert token_counts.token_counts(empty(spark), RANK_PATH).count() == 0


# ---- language -------------------------------------------------------------------------------------

def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    emit, trans, m = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), 3
    starts, lens = np.array([0, 4, 5]), np.array([4, 1, 4])
    got, pairs = crf_langid._marginals(emit, starts, lens, trans, want_pairs=True)
    want, want_pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for s, n in zip(starts, lens):
        weights = {p: math.exp(sum(emit[s + t, p[t]] for t in range(n)) + sum(trans[p[t - 1], p[t]] for t in range(1, n)))
                   for p in itertools.product(range(m), repeat=int(n))}
        z = sum(weights.values())
        for p, w in weights.items():
            for t in range(n):
                want[s + t, p[t]] += w / z
                if t:
                    want_pairs[p[t - 1], p[t]] += w / z
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_langid_odd_rows_and_code_switch(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = crf_langid.fit(crf_langid.training_sample(docs, "doc_id", "text", "lang", 50, 20_000), rounds=15)
    f = crf_langid._labeller(model)
    langs, scores = f([None, "", "123 !?", "²³", "the of and\nund die der das ist nicht eine"])
    assert langs[:4] == ["und"] * 4 and scores[:4] == [0.0] * 4 and langs[4] == "de" and 0.5 < scores[4] < 1
    out = crf_langid.identify(odd_docs(spark).drop("lang_pred", "score"), training=docs)
    assert out.count() == len(ODD) + 2
    nothing = crf_langid.identify(odd_docs(spark).select("doc_id", "text"), training=empty(spark)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_langid_learns_from_long_texts_only(spark):
    words = {"en": "the of and to in that is was for", "de": "und die der das ist nicht eine auch"}
    docs = spark.createDataFrame([(i, f"{words[k]} {i} " * 200, k) for i, k in enumerate(["en", "de"] * 4)]
                                 + [(8, "0 " * 3000 + "les des une est dans pour qui", "fr")], "doc_id long, text string, lang string")
    sample = crf_langid.training_sample(docs, "doc_id", "text", "lang", 50, 1000)
    assert sorted(lang for lang, _ in sample) == ["de"] * 4 + ["en"] * 4 + ["fr"] and all(len(t) <= 1000 for _, t in sample)
    assert all(t in docs.where(F.col("text").contains(t)).first().text for _, t in sample[:1])
    found = crf_langid.identify(docs.select("doc_id", "text"), training=docs, max_chars=1000).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {i: k for i, k in enumerate(["en", "de"] * 4 + ["fr"])}


def test_langid_held_out_accuracy(spark):
    found = queries.QUERIES["op1_crf_langid"](spark, SF_MID).where("held_out")
    truth = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    r = found.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert r > 0.97


# ---- passages -------------------------------------------------------------------------------------

def without_repeats(docs, n=100):
    seen, out = set(), {}
    for i, b in sorted(docs):
        cover = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if b[k:k + n] in seen:
                cover[k:k + n] = b"\1" * n
            seen.add(b[k:k + n])
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out[i] = (len(b), sum(cover), sum(bool(c) and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover)),
                  hashlib.sha256(kept).hexdigest())
    return out


def passage_docs():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, line = text(300), text(30)
    docs = [base, base, base[:700] + "X" + base[701:], base[350:900] + text(20), "ab" * 400, "ab" * 300 + base[:99], base[:100], base[:99],
            "é" * 120 + line, "ü" * 120 + line, None, ""]
    docs += [text(25) + " " + line + " " + text(25) for _ in range(25)] + [line + text(3) for _ in range(10)]
    docs += ["\0" * 150 + line, "\0" * 260]
    return list(enumerate(docs))


@pytest.mark.parametrize("class_rows", [suffix_dedup.CLASS_ROWS, 2])
def test_passages_equal_brute_force(spark, class_rows):
    docs = passage_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r[1:]) for r in suffix_dedup.digests(df, class_rows=class_rows).collect()}
    assert got == without_repeats([(i, (t or "").encode()) for i, t in docs])


def test_passages_of_very_long_texts_and_table(spark, monkeypatch):
    docs = sample_texts(250)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r[1:]) for r in suffix_dedup.digests(df).collect()}
    assert got == without_repeats([(i, t.encode()) for i, t in docs])
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)  # texts by stretches
    import pyarrow as pa
    whole = docs[0][1] + docs[1][1] + docs[0][1]
    parts = list(suffix_dedup._cut(100, True)([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([whole])], names=["a", "b"])]))
    assert sum(p.num_rows for p in parts) > len(whole) // 100


def test_repeat_groups_name_their_first(spark):
    docs = dict(passage_docs())
    rows = suffix_dedup.repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert rows
    for r in rows:
        a, b = (docs[r.doc] or "").encode(), (docs[r.first_doc] or "").encode()
        assert r.end - r.start >= 100 and (r.first_doc, r.first_start) < (r.doc, r.start)
        assert a[r.start:r.end] == b[r.first_start:r.first_start + r.end - r.start]


def test_interval_tree_reports_each_member_at_its_deepest_group():
    text = b"xabcyabcxabcz"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0] + [len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(text[a:], text[b:])))) for a, b in zip(order, order[1:])]
    before = np.array([text[i - 1] if i else -1 for i in order])
    told = {(order[m], int(d), order[f]) for m, d, f in suffix_dedup.interval_tree(np.array(common), before, np.array(order), 3)}
    assert told == {(8, 4, 0), (5, 3, 1), (9, 3, 1)}  # "xabc" at 0 and 8; "abc" at 1, 5 and 9


def test_passage_removal_keeps_rows_and_characters(spark):
    df = odd_docs(spark).withColumn("_spans", F.lit(1))
    out = suffix_dedup.remove(df)
    assert out.columns == df.columns and out.count() == df.count()
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[7].startswith("same words again ") and len(rows[7]) < 150 and rows[None] == "no id here" and rows[0] is None
    cut = suffix_dedup.remove(spark.createDataFrame([(1, "é" * 120), (2, "aé" * 3 + "é" * 120)], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in cut.collect()}[2] == "aé" * 3 or len({r.text for r in cut.collect()}) == 2
    assert suffix_dedup.digests(empty(spark)).count() == 0


# ---- SimHash --------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    texts = [t for _, t in sample_texts(150)] + ODD
    got = simhash.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == prints
    component = {i: i for i in prints}
    for _ in prints:
        new = {i: min(component[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        if new == component:
            break
        component = new
    assert {r.doc_id: r.component_id for r in got} == component


def test_simhash_links_every_close_pair(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        chain = f
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                chain ^= 1 << b
            fps.append(chain)
    fps = sorted({f - (1 << 63) for f in fps})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    def parts(pairs):
        root = {f: f for f in fps}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {f: find(f) for f in fps}
    mask = (1 << 64) - 1
    close = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & mask).bit_count() <= 3]
    assert parts(edges) == parts(close)


def test_simhash_keep_one(spark):
    df = odd_docs(spark).withColumn("fp", F.lit("clash"))
    kept = simhash.keep_one(df)
    ids = sorted([r.doc_id for r in kept.collect()], key=lambda x: (x is None, x))
    assert kept.columns == df.columns and 9 not in ids and 8 in ids and ids.count(4) == 1 and None in ids and 1 not in ids and 0 in ids
    assert simhash.keep_one(empty(spark)).count() == 0


def test_simhash_keep_one_tells_rows_of_one_id_apart(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(1, a), (2, a), (2, b), (2, b), (2, c), (3, c), (4, d), (4, None), (4, ""), (5, b), (None, a)]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n_row long")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(str, {(r.doc_id, r.text) for r in kept.collect()})) == sorted(map(str, [(1, a), (2, b), (2, c), (4, d), (4, None), (None, a)]))
    assert kept.count() == 6


def test_connected_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(250)] + [(7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k in got} and all(root[x] == x for x in root if x not in got)
    assert connected_components(empty(spark, "a long, b long")).count() == 0


# ---- embeddings -----------------------------------------------------------------------------------

def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 24))
    x = np.concatenate([x, x[:60] + 0.1 * rng.normal(size=(60, 24)), x[:5], x[:5] * 3, np.repeat(x[:1], 40, 0) + 0.01 * rng.normal(size=(40, 24))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] + [1.0] * 23), (9004, [None] + [1.0] * 23), (None, x[0].tolist()), (9005, []),
           (9006, [float("inf")] * 24), (9007, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pq_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.9 * close.sum() <= found <= close.sum()
    exact = {r.vec_id: r for r in pq_dedup.near_duplicates(df, reach=1.0, lists=9).collect()}
    assert [exact[i].n_links for i in range(len(x))] == close.sum(1).tolist()
    label = np.arange(len(x))
    for _ in range(50):
        label = np.array([min(label[i], *label[close[i]]) if close[i].any() else label[i] for i in range(len(x))])
    assert [exact[i].component_id for i in range(len(x))] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9001, 9008) if i != 9007)
    assert got[None].n_links == 0 and got[None].component_id is None
    assert pq_dedup.near_duplicates(empty(spark, "vec_id long, embedding array<float>")).count() == 0


def test_embedding_links_of_a_low_rank_cluster_are_exact(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=64) + rng.normal(size=(800, 3)) @ rng.normal(size=(3, 64)) * 0.22
    x = np.concatenate([hot, rng.normal(size=(1600, 64)), hot[:3]])  # the last are copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    got = {r.vec_id: r.n_links for r in pq_dedup.near_duplicates(df).collect()}
    assert close.sum() > 50_000 and [got[i] for i in range(len(x))] == close.sum(1).tolist()


def test_embedding_blocks_give_the_same(spark, monkeypatch):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    near = df.select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda v: (v * 1.01 + 0.002).cast("float")).alias("embedding"), "label")
    df = df.unionAll(near)
    whole = sorted(pq_dedup.near_duplicates(df).collect())
    monkeypatch.setattr(pq_dedup, "BLOCK", 16)
    monkeypatch.setattr(pq_dedup, "QUERIES", 64)
    assert sorted(pq_dedup.near_duplicates(df).collect()) == whole and sum(r.n_links for r in whole) >= 900


# ---- statistics, rules ----------------------------------------------------------------------------

def plain_stats(t):
    words = regex.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    counts = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    again = {k for i in range(len(words) - 7) if counts[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))


def test_text_stats(spark):
    texts = ODD + [t for _, t in sample_texts(200)] + ["a b c d e f g h " * 3 + "i", "w " * 9, "#*$%&|<> x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in text_stats.text_stats(df).collect()}
    assert got == {i: plain_stats(t) for i, t in enumerate(texts)}


def test_decision_list_learns_and_survives_odd_labels(spark):
    rows = [(i, 0 if i % 4 == 0 else 1, 100.0, 5.0, 0.2 + i % 3 / 100 if i % 4 == 0 else i % 5 / 100, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
            for i in range(2000)]
    train = spark.createDataFrame(rows, ["doc_id", "_label", *text_stats.features()])
    rules = decision_list.learn(train)
    assert len(rules) == 1 and rules[0][0][:2] == ("symbol_ratio", ">") and 0.04 <= rules[0][0][2] < 0.2
    assert decision_list.learn(train.where("_label = 1")) == [] == decision_list.learn(train.where("false"))
    stats = text_stats.text_stats(odd_docs(spark))
    assert stats.select(decision_list.verdict(rules).alias("k")).where("k is null").count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r._label) for r in text_stats.labelled(stats, labels, "doc_id", "quality", 100).collect()} == {(4, 1)}


def test_rule_ensemble(spark):
    stats = text_stats.text_stats(odd_docs(spark))
    assert {r[0] for r in stats.select(rule_ensemble.score((0.0, []))).collect()} == {0.5}
    names = list(text_stats.features())
    assert rule_ensemble.fit(np.zeros((0, len(names))), np.zeros(0, int), names)[1] == []
    assert rule_ensemble.fit(np.ones((30, len(names))), np.ones(30, int), names)[1] == []
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(names)))
    y = ((x[:, 2] < 0.8) & (x[:, 5] < 0.9)).astype(int)
    bias, rules = rule_ensemble.fit(x, y, names)
    z = bias + sum(w * np.all([x[:, names.index(s)] <= t if op == "<=" else x[:, names.index(s)] > t for s, op, t in r], axis=0) for r, w in rules)
    assert rules and len(rules) < 200 and ((z > 0) == y).mean() > 0.98


@pytest.mark.parametrize("name, column, bad", [("op6_decision_list", "kept", False), ("op8_rule_ensemble", "predicted", 0)])
def test_quality_verdicts_follow_labels(spark, name, column, bad):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = found.join(labels, "doc_id")
    if "held_out" in found.columns:
        r = r.where("held_out")
    low = r.where("quality = 0").agg(F.avg((F.col(column) == F.lit(bad)).cast("double"))).first()[0]
    rejected = r.where("quality = 1").where(F.col(column) == F.lit(bad))
    if "base_failed" in found.columns:
        rejected = rejected.where("not base_failed")
    assert low > 0.9 and rejected.count() < 0.02 * r.where("quality = 1").count()


# ---- mixing, chats --------------------------------------------------------------------------------

@pytest.mark.parametrize("shares", [{"a": 1, "b": 2, "c": 4}, {"a": 333, "b": 5, "c": 11, "d": 651}, {"x": 7}])
def test_pfair_period_stays_within_a_block(spark, shares):
    rows = mixing.period(spark.createDataFrame(list(shares.items()), "source string, share long")).orderBy("at").collect()
    slots, done = sum(shares.values()), Counter()
    assert len(rows) == slots
    for r in rows:
        assert r.j == done[r.source] and r.j * slots // shares[r.source] <= r["at"] < -(-(r.j + 1) * slots // shares[r.source])
        done[r.source] += 1
        assert all(abs(done[k] - (r["at"] + 1) * v / slots) < 1 for k, v in shares.items())


def test_mix_keeps_all_rows(spark):
    df = odd_docs(spark).withColumn("_key", F.lit(1)).withColumn("slot_", F.lit(2))
    out = mixing.interleave(df, mixing.square_root_shares(df), block_rows=2)
    assert out.columns == df.columns + ["block", "slot", "position", "on_target"] and out.count() == df.count()
    assert out.where("position is null").count() == 0 and out.select("position").distinct().count() == df.count()
    part = mixing.interleave(df, mixing.square_root_shares(df).where("source = 's1'"), block_rows=2)
    assert part.count() == df.count() and part.where("source = 's1' and slot is null").count() == 0
    assert mixing.interleave(empty(spark), mixing.square_root_shares(empty(spark))).count() == 0


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 700, "ann", "bye"), (1, 700, "ann", "bye"),
             (2, 0, "system", "alone"), (None, 3, None, "who"), (None, None, "", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1))
    rows = perspectives.perspectives(df).collect()
    assert {(r.conv_id, r.perspective) for r in rows} == {(1, "ann"), (1, "bob"), (None, "unknown")}
    for who in ("ann", "bob"):
        own = sorted((r for r in rows if r.perspective == who and r.conv_id == 1), key=lambda r: r.seq)
        text = "".join(r.rendered for r in own)
        assert [r.seq for r in own] == [1, 2, 3, 4, 5] and own[-1].char_end == len(text)
        for r in own:
            assert text[r.char_start:r.char_end] == r.rendered
        masked = [text[r.mask_start:r.mask_end] for r in own if r.trained]
        assert masked == (["hi<|im_end|>", "bye<|im_end|>", "bye<|im_end|>"] if who == "ann" else ["<|im_end|>"])
    assert perspectives.perspectives(empty(spark, "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    ok, message = compare(queries.QUERIES[name](spark, SF_MID), queries.ORACLES[name], duck(SF_MID))
    assert ok, message
