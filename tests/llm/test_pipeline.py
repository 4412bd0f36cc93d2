"""The pipeline's stages against plain re-computations, and on odd tables."""

import hashlib
from collections import Counter

import corpus_pipeline
from conftest import SF_SMALL
from test_operators import empty, odd_docs, plain_fingerprint, without_repeats
from tokenizers import Tokenizer
import public_tokenizers

from revline.llm import mixing
from revline.session import materialize


def test_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "source_mixing",
                                                      "bpe_encode_decode"]


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    first = corpus_pipeline.language_id(spark, docs, SF_SMALL)
    assert first.columns == docs.columns
    kept = {r.doc_id for r in first.collect()}
    assert len(kept) >= 0.98 * len(rows)
    second = corpus_pipeline.simhash_near_dedup(spark, first, SF_SMALL)
    prints = {i: plain_fingerprint(rows[i].text) for i in kept}
    label = {i: i for i in kept}
    for _ in kept:
        new = {i: min(label[j] for j in kept if (prints[i] ^ prints[j]).bit_count() <= 3) for i in kept}
        if new == label:
            break
        label = new
    one = {i for i in kept if label[i] == i}
    assert {r.doc_id for r in second.collect()} == one
    third = corpus_pipeline.suffix_array_dedup(spark, second, SF_SMALL)
    left = {r.doc_id: r for r in third.collect()}
    exact = without_repeats([(i, rows[i].text.encode()) for i in one])
    for i, r in left.items():
        n, removed, spans, digest = exact[i]
        assert n - removed <= len(r.text.encode()) <= n - removed + 6 * spans and r.n_chars == len(r.text)
        if len(r.text.encode()) == n - removed:
            assert hashlib.sha256(r.text.encode()).hexdigest() == digest
    fourth = corpus_pipeline.source_mixing(spark, third, SF_SMALL)
    assert sorted(map(tuple, fourth.collect())) == sorted(map(tuple, left.values()))
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in corpus_pipeline.bpe_encode_decode(spark, fourth, SF_SMALL).collect():
        ids = ref.encode(left[r.doc_id].text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(left[r.doc_id].text.encode()).hexdigest()


def test_mix_is_the_order_of_the_result(spark):
    names = ["hot"] * 700 + ["b"] * 300 + ["c"] * 40
    docs = materialize(spark.createDataFrame([(i, f"text {i} " * (1 + i * 37 % 50), "en", s, None) for i, s in enumerate(names)],
                                             "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    # Several files, dealt by size when they are read again.
    new = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        mixed = materialize(corpus_pipeline.source_mixing(spark, docs, SF_SMALL), "mixed")
        assert len(mixed.inputFiles()) > 2
        last = materialize(corpus_pipeline.bpe_encode_decode(spark, mixed, SF_SMALL), "last")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = sorted(last.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(names))) and last.columns[-1] != "text"
    shares = {r.source: r.share for r in mixing.square_root_shares(docs).collect()}
    total, size = sum(shares.values()), Counter(names)
    got = Counter()
    for n, r in enumerate(rows, 1):
        got[r.source] += 1
        assert all(abs(got[s] - n * a / total) <= corpus_pipeline.BLOCK_ROWS for s, a in shares.items())
        if got[r.source] == size[r.source]:
            break
    assert n > 150
    wanted = mixing.interleave(docs, mixing.square_root_shares(docs), block_rows=corpus_pipeline.BLOCK_ROWS).orderBy("position").collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in wanted]
    for path in last.inputFiles():  # the files hold stretches of the order
        places = [r.position for r in spark.read.parquet(path).coalesce(1).collect()]
        assert places == list(range(places[0], places[0] + len(places)))


def test_stages_on_odd_and_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF_SMALL).count() == 0
        assert stage(spark, odd_docs(spark), SF_SMALL).count() <= 14
