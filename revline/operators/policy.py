"""Policy retrieval by shared terms or by embeddings, and the per-file policy finding.

Term retrieval joins document terms to policy terms on the term. Every term counts; ``max_df`` below 1
is a choice of the caller that drops terms found in more than that share of the policies. The policy side is not broadcast by hand: AQE broadcasts it when its measured size is
under the threshold and keeps the shuffle join (with skew splitting) otherwise.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


TERM_REGEX = "[a-z0-9]+"
# --- fixed values: the policy finding and the index message ---------------------------------------
POLICY_TITLE = "Applied Local Policy"
POLICY_PREFIX = "Verified against standard: "
INDEX_MESSAGE = "Indexed %d policy documents."
# ----------------------------------------------------------------------------------------------------


def terms(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Distinct lower-case alphanumeric terms per row: (key, term)."""
    return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM_REGEX), 0)))
                     .alias("term"))


def policy_terms(policies: DataFrame, key: str = "item_id", text: str = "text", max_df: float = 1.0) -> DataFrame:
    """The policy index: (term, policy key) for terms in at most ``max_df`` of the policies."""
    t = terms(policies, key, text)
    if max_df >= 1:
        return t
    n_policies = policies.select(F.count(F.lit(1))).scalar()
    df_ = t.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    # exact decimal arithmetic: no float rounding at the cut
    keep = df_.filter(F.col("_df") <= n_policies * F.lit(Decimal(str(max_df)))).select("term")
    return t.join(keep, "term", "left_semi")


def topk_policies(docs: DataFrame, policies: DataFrame, k: int = 3, doc_key: str = "doc_id",
                  policy_key: str = "item_id", max_df: float = 1.0) -> DataFrame:
    """D15 (a): top-k policies per document by shared informative terms; ties by policy key."""
    d = terms(docs, doc_key)
    p = policy_terms(policies, policy_key, max_df=max_df)
    scores = d.join(p, "term").groupBy(doc_key, policy_key).agg(F.count(F.lit(1)).alias("score"))
    w = Window.partitionBy(doc_key).orderBy(F.col("score").desc(), F.col(policy_key))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select(doc_key, "rank", policy_key, "score")


def policy_findings(files: DataFrame, best: DataFrame, key: str = "doc_id", file_col: str = "file",
                    policy_key: str = "item_id") -> DataFrame:
    """One info/policy finding per file naming its best policy (or none)."""
    top1 = best.filter(F.col("rank") == 1).select(key, policy_key)
    desc = F.concat(F.lit(POLICY_PREFIX),
                    F.coalesce(F.concat(F.lit("policy "), F.col(policy_key).cast("string")), F.lit("no matching policy")))
    return files.join(top1, key, "left").select(
        key, F.col(file_col).alias("file"), F.lit(1).alias("line"), F.lit("info").alias("severity"),
        F.lit("policy").alias("category"), F.lit(POLICY_TITLE).alias("title"), desc.alias("description"))


def index_message(policies: DataFrame) -> DataFrame:
    """A5: ``Indexed N policy documents.``"""
    return policies.agg(F.format_string(INDEX_MESSAGE, F.count(F.lit(1))).alias("message"))


# ---- D15 (b): embeddings ---------------------------------------------------------------------

def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a, b):
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def centroids(vectors: DataFrame, group: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per group (one aggregate over (group, dimension); bounded by the dimension)."""
    cells = vectors.select(group, F.posexplode(F.col(vec)).alias("_i", "_x")) \
        .groupBy(group, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return cells.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_c")) \
        .select(group, F.transform("_c", lambda s: s["_m"]).alias("centroid"))


def cosine_topk(queries: DataFrame, candidates: DataFrame, k: int = 3, q_key: str = "vec_id",
                q_vec: str = "embedding", c_key: str = "label", c_vec: str = "centroid",
                block_size: int = 256) -> DataFrame:
    """Exact top-k candidates per query by cosine similarity.

    Candidates are hashed into blocks of about ``block_size`` vectors (one row per block). Queries
    meet each block through an equi-join on the block id, score the block's vectors inside one
    expression and keep the block's top k; the per-block top k are merged by a second top k. No
    candidate is skipped; the work is queries × candidates, spread over blocks.
    """
    # hash blocks: about block_size candidates each, without a global numbering pass
    n_cands = candidates.select(F.count(F.lit(1))).scalar()
    n_blocks = F.greatest(F.ceil(n_cands / F.lit(block_size)), F.lit(1))
    cands = candidates.select(c_key, F.col(c_vec).cast("array<double>").alias("_v"))
    blocks = cands.groupBy(F.pmod(F.xxhash64(F.col(c_key)), n_blocks).cast("int").alias("_b")) \
        .agg(F.collect_list(F.struct(F.col(c_key).alias("key"), F.col("_v").alias("v"))).alias("_cands"))
    q = queries.select(q_key, F.col(q_vec).cast("array<double>").alias("_q")) \
        .withColumn("_b", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))
    joined = q.join(blocks, "_b")
    scored = F.transform("_cands", lambda c: F.struct((-cosine(F.col("_q"), c["v"])).alias("neg"),
                                                      c["key"].alias("key"), cosine(F.col("_q"), c["v"]).alias("sim")))
    per_block = joined.select(q_key, F.explode(F.slice(F.array_sort(scored), 1, k)).alias("s"))
    wq = Window.partitionBy(q_key).orderBy(F.col("s.neg"), F.col("s.key"))
    return per_block.withColumn("rank", F.row_number().over(wq)).filter(F.col("rank") <= k) \
        .select(q_key, "rank", F.col("s.key").alias(c_key), F.col("s.sim").alias("similarity"))
