"""Rerank retrieved chunks and keep the best few per query."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text as tx
from .topk import SCORE_DIGITS, rank_by_score


def coverage_score(query="query", text="text") -> Column:
    """Share of the distinct query terms that occur in the text. A stand-in
    scorer that needs no model and stays in Catalyst."""
    wanted = F.array_distinct(tx.terms(F.col(query)))
    found = F.size(F.array_intersect(wanted, tx.terms(F.col(text))))
    return F.when(F.size(wanted) > 0, F.round(found / F.size(wanted), SCORE_DIGITS)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, scorer=None, n=schemas.RERANK_TOP_N) -> DataFrame:
    """The `n` candidates per query with the highest relevance, ties by id.

    `candidates` has `query_id`, `query`, `chunk_id` and `text`. `scorer()`
    runs once per task and returns a function from two lists, queries and
    texts, to a list of numbers; without one, term coverage is used. `score`
    and `rank` are replaced.
    """
    rows = candidates.drop("score", "rank")
    if scorer is None:
        scored = rows.withColumn("score", coverage_score())
    else:
        schema = T.StructType(rows.schema.fields + [T.StructField("score", T.DoubleType())])

        def run(frames):
            model = scorer()
            for frame in frames:
                relevance = model(frame["query"].tolist(), frame["text"].tolist())
                yield frame.assign(score=pd.Series(relevance, index=frame.index, dtype="float64"))

        scored = rows.mapInPandas(run, schema)
    return rank_by_score(scored, n)
