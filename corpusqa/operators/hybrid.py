"""Reciprocal rank fusion (Cormack et al., 2009) of a dense and a lexical leg."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .dense import dense_topk
from .lexical import bm25_topk
from .topk import SCORE_DIGITS, rank_by_score


def reciprocal_rank_fusion(legs, k=schemas.TOP_K, *, rrf_k=schemas.RRF_K) -> DataFrame:
    """Fuse ranked lists: a chunk scores the sum of `1 / (rrf_k + rank)` over its lists."""
    ranked = reduce(DataFrame.unionByName, [leg.select("query_id", "chunk_id", "rank") for leg in legs])
    share = F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))
    fused = ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(share), SCORE_DIGITS).alias("score"))
    return rank_by_score(fused, k)


def hybrid_topk(chunks, index, queries, k=schemas.TOP_K, *, leg_k=None, rrf_k=schemas.RRF_K, dense=dense_topk):
    """Dense and BM25 lists of `leg_k` rows each, fused. Filters apply to both legs.

    `dense` is any `(chunks, queries, k)` search, exact or approximate.
    """
    leg_k = leg_k or k
    return reciprocal_rank_fusion(
        [dense(chunks, queries, leg_k), bm25_topk(index, queries, leg_k)], k, rrf_k=rrf_k
    )
