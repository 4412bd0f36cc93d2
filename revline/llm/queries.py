"""One registered query per operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revline.llm import (bpe, crf_langid, decision_list, hard_negatives, mixing, periodic_runs, perspectives, pq_dedup, quartile_digest, rule_ensemble,
                         simhash, suffix_dedup, text_stats, token_counts)
from revline.llm.common import crc_mod, documents
from revline.session import materialize

LABELLED_ROWS = 20_000  # bound of the labelled sample that a classifier is fitted on

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("op1_crf_langid")
def op1(spark, sf_dir):
    """Language of every document; learned from the documents that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    found = crf_langid.identify(docs.select("doc_id", "text"), training=docs.where(~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    """What is left of every document without 100-byte strings that start earlier."""
    return suffix_dedup.digests(documents(spark, sf_dir).select("doc_id", "text"), length=100)


@query("op3_simhash")
def op3(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.components(documents(spark, sf_dir).select("doc_id", "text"), words_per_shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_perspectives")
def op4(spark, sf_dir):
    """Every conversation rendered for each of its participants, turn by turn, with loss masks."""
    return perspectives.perspectives(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))


ORACLES["op4_perspectives"] = """
WITH t AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker, coalesce(text, '') AS body
  FROM conversations),
r AS (
  SELECT t.*, w.perspective,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM t JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system') w
    ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
h AS (
  SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM r),
o AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered,
         row_number() OVER w AS seq,
         CAST(sum(length(head || body || '<|im_end|>' || chr(10))) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end
  FROM h WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body))
SELECT conv_id, perspective, seq, turn, chat_role, CASE WHEN chat_role = 'user' THEN speaker END AS name, rendered,
       char_end - length(rendered) AS char_start, char_end, chat_role = 'assistant' AS trained,
       CASE WHEN chat_role = 'assistant' THEN char_end - length(rendered) + length(head) END AS mask_start,
       CASE WHEN chat_role = 'assistant' THEN char_end - 1 END AS mask_end
FROM o
"""


@query("op5_pfair_mix")
def op5(spark, sf_dir):
    """Place of every document in a mix whose weights follow the square root of the source sizes."""
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mixing.interleave(docs, mixing.square_root_shares(docs), block_rows=32)


ORACLES["op5_pfair_mix"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS key, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS h FROM documents),
n AS (SELECT key, count(*) AS n FROM d GROUP BY key),
shares AS (
  SELECT key, n, greatest(1, CAST(floor(1000 * sqrt(CAST(n AS DOUBLE)) / sum(sqrt(CAST(n AS DOUBLE))) OVER () + 0.5) AS BIGINT)) AS share FROM n),
s AS (SELECT list(key ORDER BY key) AS keys, list(share ORDER BY key) AS a, CAST(sum(share) AS BIGINT) AS slots FROM shares),
edf(t, done, pick, j) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM s
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p, done[p]
  FROM (
    SELECT t, done, slots, CAST(list_sort(list_filter(list_transform(done, lambda x, i:
             CASE WHEN x < a[i] AND (x * slots) // a[i] <= t + 1
                  THEN {'due': ((x + 1) * slots + a[i] - 1) // a[i], 'i': i} END), lambda y: y IS NOT NULL))[1].i AS BIGINT) AS p
    FROM edf, s WHERE t + 1 < slots)),
plan AS (SELECT keys[pick] AS key, a[pick] AS share, slots, j, t AS run_at FROM edf, s WHERE t >= 0),
ended AS (
  SELECT min((((n + 31) // 32) // p.share) * slots + run_at) AS fin
  FROM plan p JOIN n USING (key) WHERE ((n + 31) // 32) % p.share = j),
ranked AS (
  SELECT doc_id, source, key, row_number() OVER (PARTITION BY key ORDER BY h, doc_id) - 1 AS rnk FROM d),
placed AS (
  SELECT r.*, rnk // 32 AS block, ((rnk // 32) // s2.share) * (SELECT slots FROM s) + p.run_at AS slot
  FROM ranked r JOIN shares s2 USING (key) JOIN plan p ON p.key = r.key AND p.j = (rnk // 32) % s2.share)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot,
       CAST(slot * 32 + rnk % 32 AS BIGINT) AS position, slot < (SELECT fin FROM ended) AS on_target
FROM placed
"""


@query("op6_decision_list")
def op6(spark, sf_dir):
    """Text statistics, base checks, and the verdict of a decision list learned from the labels."""
    stats = materialize(text_stats.text_stats(documents(spark, sf_dir).select("doc_id", "text")), "stats")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    rules = decision_list.learn(text_stats.labelled(stats, labels, "doc_id", "quality", LABELLED_ROWS))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & decision_list.verdict(rules)).alias("kept"))


@query("op7_pq_dedup")
def op7(spark, sf_dir):
    """Links, component and verdict of every embedding at cosine 0.9."""
    return pq_dedup.near_duplicates(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"), cosine=0.9)


@query("op8_rule_ensemble")
def op8(spark, sf_dir):
    """Quality score of every document; learned from the labels that are not held out."""
    stats = materialize(text_stats.text_stats(documents(spark, sf_dir).select("doc_id", "text")), "stats")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    known = labels.where(crc_mod("doc_id", 5) != 0)
    model = rule_ensemble.fit_sample(text_stats.labelled(stats, known, "doc_id", "quality", LABELLED_ROWS))
    score = rule_ensemble.score(model)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return stats.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


@query("op9_token_counts")
def op9(spark, sf_dir):
    """Pre-tokens and unigram tokens of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op10_bpe_round_trip")
def op10(spark, sf_dir):
    """Token ids of every document and what they decode to, as digests."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_quartile_digest")
def op11(spark, sf_dir):
    """Digest of every document, of its edited text, and how alike they and the next document's are."""
    return quartile_digest.edit_likeness(documents(spark, sf_dir).select("doc_id", "text"))


@query("op12_hard_negatives")
def op12(spark, sf_dir):
    """Hard negatives of every fiftieth vector and each of its nearest five of the same label."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.where(F.col("label").isNotNull() & finite).select(
        "vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    found = hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLES["op12_hard_negatives"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3
"""


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    """Periodic runs of every document; in one of ten a tail is made periodic first."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("_g", F.expr("_h div 10"))
    words = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), 0))
    docs = docs.withColumn("_words", words).withColumn("_n", F.size("_words").cast("long"))
    docs = docs.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    docs = docs.withColumn("_p", F.when(F.col("_n") > 0, F.expr("1 + (_n - _a) div (3 + _g % 8)")))
    turned = F.array_join(F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))), " ")
    docs = docs.select("doc_id", F.when(F.col("_n") > 0, turned).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.periodic_runs(docs, exponent=4, least=6)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.select("doc_id", "runs", "collapsed", best.alias("_best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"), (-F.col("_best.l")).alias("length"),
        F.col("_best.p").alias("period"), F.expr("1000 * -_best.l div _best.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
