"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

1. language_id: rejects texts without a letter and texts in which no language reaches 40 % of the words.
2. simhash_near_dedup: one document of each component of near-equal fingerprints stays.
3. suffix_array_dedup: passages of 100 bytes or more that start earlier in the corpus are cut out of texts.
4. source_mixing: rows in the order of a Pfair mix of the sources, by the square root of their sizes.
5. bpe_encode_decode: token count and digests of each remaining text, and its position in the mix.

Stages 1 to 4 return the columns of ``documents``, stage 5 returns them without the text, with its results and
``position`` (from 0: the place in the written order of stage 4), and is written in that order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revline.llm import bpe, crf_langid, mixing, simhash, suffix_dedup
from revline.llm.common import documents, fresh
from revline.session import materialize

LEAST_SHARE = 0.4
BLOCK_ROWS = 32


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = fresh(docs.columns, "_lang_pred"), fresh(docs.columns, "_lang_score")
    found = crf_langid.identify(docs, keep_text=True, names=names)
    return found.where((F.col(names[0]) != crf_langid.UNKNOWN) & (F.col(names[1]) >= LEAST_SHARE)).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words_per_shingle=3, max_bits=3)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove(docs, length=100)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = tuple(fresh(docs.columns, f"_{n}") for n in ("block", "slot", "position", "on_target"))
    mixed = mixing.interleave(docs, mixing.square_root_shares(docs), block_rows=BLOCK_ROWS, names=names)
    return mixed.repartitionByRange(names[2]).sortWithinPartitions(names[2]).select(*docs.columns)


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = fresh(docs.columns, "position"), fresh(docs.columns, "_part")
    coded = bpe.round_trip(mixing.written_places(docs, parts, names), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.repartitionById(parts, F.col(names[1])).sortWithinPartitions(names[0]).drop(names[1])


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encode_decode", bpe_encode_decode),
]

# No stage but the mix can be said in SQL (learned labels, XXH64 votes, SHA-256 of token ids); see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
