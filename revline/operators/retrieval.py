"""D15 (a) with weights: the policies that fit a text best, by rare shared terms and length, exactly.

A term found in df of N policies weighs ``w = round(1e6 * ln(1 + N / df) ** 2)``; a policy is as long as the sum of
its weights; the score of a policy is ``floor(1e6 * (sum of the shared weights) / sqrt(its length))`` (the cosine of
the weighted term sets, up to the text's own length). Weights and sums are integers, so ties are exact.

A text's terms are not all joined to the index. Each index term has a bound: what it can add to any score. Taken
from the smallest bound up, the terms whose bounds sum to less than the text's k-th best score so far cannot bring in
a policy by themselves. That score is that of the k policies which the text's ``FIRST`` best-bounded terms find; the
terms beyond the cut fetch candidates, candidates that cannot reach it with all the rest are dropped, and the remaining pairs are
scored on all terms. Frequent terms have small bounds, so their postings are joined only for texts that have
nothing better.

Defined results: null and empty texts and texts without a known term have no policies; a policy without terms is
found by none; rows that repeat a key share one set of terms; ties go to the smaller policy key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revline.operators.policy import terms
from revline.session import materialize

FIRST = 12      # terms of a text that find its first policies
SCALE = 1_000_000


@dataclass
class Index:
    """An inverted index: one row per term, per posting and per policy."""
    terms: DataFrame      # term, w, bound, code
    postings: DataFrame   # term, policy, w
    policies: DataFrame   # policy, size (sqrt of the length), codes

    def __post_init__(self):
        self.key = self.policies.columns[0]


def build_index(policies: DataFrame, key: str = "item_id", text: str = "text") -> Index:
    """The index of the policies' distinct terms; written once, each policy term is one posting."""
    raw = terms(policies.where(F.col(key).isNotNull()), key, text).distinct()
    n = policies.where(F.col(key).isNotNull()).select(F.count_distinct(key)).scalar()
    df = raw.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.round(F.pow(F.log(1 + n.cast("double") / F.col("df")), 2) * SCALE).cast("long")
    known = df.select("term", weight.alias("w"))
    postings = materialize(raw.join(known, "term").select("term", F.col(key), "w"), "postings")
    code = F.concat(F.lpad(F.col("w").cast("string"), 12, "0"), "term")  # equal terms have equal codes, and a code tells its weight
    sized = materialize(postings.groupBy(key).agg(F.sqrt(F.sum("w").cast("double")).alias("size"), F.collect_list(code).alias("codes")), "policies")
    bound = F.ceil(F.max(SCALE * F.col("w").cast("double") / F.col("size")))
    bounds = postings.join(sized.select(key, "size"), key).groupBy("term", "w").agg(bound.alias("bound"))
    return Index(materialize(bounds.withColumn("code", code), "terms"), postings, sized)


def _score(weights, size):
    return F.floor(SCALE * weights.cast("double") / size)


def topk(docs: DataFrame, index: Index, k: int = 3, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(key, rank, policy key, score) of the k best policies of each text.

    ``parts``: the texts, and what is written of them, are dealt by key into so many parts. With a small index all further
    steps stay inside them, so more parts for more texts keep a task's memory.
    """
    pkey = index.key

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, key) if parts else df

    docs = dealt(docs)
    own = terms(docs.where(F.col(key).isNotNull()), key, text).distinct().join(index.terms, "term")
    up = Window.partitionBy(key).orderBy("bound", "term")
    down = Window.partitionBy(key).orderBy(F.desc("bound"), F.desc("term"))
    own = dealt(materialize(own.select(key, "term", "w", "bound", "code", F.sum("bound").over(up).alias("_upto"),
                                       F.row_number().over(down).alias("_nth")), "doc-terms"))
    size = index.policies.select(pkey, "size")

    def partial(part: DataFrame) -> DataFrame:
        """Shared weights of the texts' terms in ``part`` with each policy."""
        return part.select(key, "term").join(index.postings, "term").groupBy(key, pkey).agg(F.sum("w").alias("_w"))

    whole = F.aggregate(F.array_intersect("_codes", "codes"), F.lit(0).cast("long"), lambda s, c: s + F.substring(c, 1, 12).cast("long"))

    def scored(pairs: DataFrame) -> DataFrame:
        """Pairs with the text's codes, scored on all terms."""
        return pairs.join(index.policies, pkey).select(key, pkey, _score(whole, F.col("size")).alias("score"))

    codes = own.groupBy(key).agg(F.collect_list("code").alias("_codes"))
    nth = Window.partitionBy(key).orderBy(F.desc("_s"), pkey)
    first = partial(own.where(F.col("_nth") <= FIRST)).join(size, pkey).select(key, pkey, _score(F.col("_w"), F.col("size")).alias("_s"))
    first = first.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= k).select(key, pkey)
    floor = scored(first.join(codes, key)).groupBy(key).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_floor"))
    asked = dealt(materialize(own.join(floor, key, "left").withColumn("_floor", F.coalesce("_floor", F.lit(0)))
                              .select(key, "term", "_floor", "code", (F.col("_upto") >= F.col("_floor")).alias("_fetch"), "bound"), "doc-asked"))
    spared = asked.groupBy(key).agg(F.max("_floor").alias("_floor"), F.sum(F.when(~F.col("_fetch"), F.col("bound")).otherwise(0)).alias("_rest"),
                                    F.collect_list("code").alias("_codes"))
    found = partial(asked.where("_fetch")).join(size, pkey).join(spared, key) \
        .where(_score(F.col("_w"), F.col("size")) + 1 + F.col("_rest") >= F.col("_floor")).select(key, pkey, "_codes")
    best = Window.partitionBy(key).orderBy(F.desc("score"), pkey)
    return scored(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(key, "rank", pkey, "score")

