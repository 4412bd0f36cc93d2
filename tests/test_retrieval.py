"""Weighted retrieval: equal to scoring every pair; frequent terms are not joined to every text."""

import math
import random
import re

from pyspark.sql import functions as F

from conftest import SF_MID
from revline.operators import retrieval


def plain(docs, policies, k):
    """Every pair scored."""
    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    pol = {}
    for key, t in policies:
        if key is not None:
            pol.setdefault(key, set()).update(words(t))
    n, df = len(pol), {}
    for s in pol.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    w = {t: round(1e6 * math.log(1 + n / c) ** 2) for t, c in df.items()}
    own, out = {}, set()
    for key, t in docs:
        if key is not None:
            own.setdefault(key, set()).update(words(t))
    for key, mine in own.items():
        sc = sorted((-math.floor(1e6 * sum(w[t] for t in mine & s) / math.sqrt(sum(w[t] for t in s))), p) for p, s in pol.items() if mine & s)
        out |= {(key, i + 1, p, -x) for i, (x, p) in enumerate(sc[:k])}
    return out


def frames(spark, docs, policies):
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            retrieval.build_index(spark.createDataFrame(policies, "item_id long, text string")))


def test_equal_to_scoring_every_pair(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(vocab, [1 / (i + 1) for i in range(400)], k=n))
    policies = [(i, text(rng.randint(1, 40))) for i in range(120)] + [(120, None), (121, ""), (122, "W0 w0"), (None, "w1"), (5, "again w399")]
    docs = [(i, text(rng.randint(1, 80))) for i in range(150)] + [(150, None), (151, ""), (152, "unheard"), (153, "w0"), (None, "w1"), (3, "w7")]
    d, index = frames(spark, docs, policies)
    for k in (1, 4):
        assert {tuple(r) for r in retrieval.topk(d, index, k).collect()} == plain(docs, policies, k)
    none = retrieval.build_index(spark.createDataFrame([], "item_id long, text string"))
    assert retrieval.topk(d, none).count() == 0
    assert retrieval.topk(spark.createDataFrame([], "doc_id long, text string"), index).count() == 0


def test_a_security_standard_is_found(spark):
    policies = [(1, "Use parameterised statements for all database access; never build SQL from user input."),
                (2, "All public functions must have a docstring and a test."), (3, "Files must end with a newline.")]
    docs = [(1, "def find(user):\n    # build sql from user input\n    return db.execute('SELECT * FROM t WHERE name = ' + user)")]
    assert retrieval.topk(*frames(spark, docs, policies), k=1).first().item_id == 1


def test_frequent_terms_are_joined_to_few_documents(spark, monkeypatch):
    """Whole tables: the texts whose most frequent known term is fetched, and the postings joined, against a full join."""
    docs, policies = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "benchmark"))
    index = retrieval.build_index(policies)
    written = []
    write = retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    retrieval.topk(docs, index).count()
    asked = written[-1]
    common = asked.groupBy("term").count().orderBy(F.desc("count")).first()
    df = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = asked.join(df, "term").agg(F.sum("df").alias("full"), F.sum(F.when(F.col("_fetch"), F.col("df")).otherwise(0)).alias("part")).first()
    fetched = asked.where(F.col("_fetch") & (F.col("term") == common.term)).count()
    print("postings joined", n.part, "of", n.full, "; most frequent term fetched for", fetched, "of", common["count"])
    assert n.part < 0.6 * n.full and fetched < 0.5 * common["count"]


def test_dealt_texts_find_the_same_policies(spark):
    policies = [(i, " ".join(f"w{j}" for j in range(i % 7, 40, i % 5 + 1))) for i in range(30)]
    docs = [(i, " ".join(f"w{j}" for j in range(i % 11, 50, i % 3 + 1))) for i in range(60)] + [(None, "w1"), (3, "w7"), (60, None)]
    d, index = frames(spark, docs, policies)
    assert {tuple(r) for r in retrieval.topk(d, index, 3, parts=5).collect()} == plain(docs, policies, 3)
