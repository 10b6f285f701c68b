"""Retrieval in one call, and evaluation of a search over test cases."""

import numpy as np
from pyspark.sql import DataFrame

from .. import schemas
from ..operators import evaluation as ev
from ..operators.approximate import IvfIndex, ivf_topk
from ..operators.dense import dense_topk, nearest_chunks
from ..operators.embedding import embed_queries
from ..operators.entities import resolve_requests
from ..operators.hybrid import hybrid_topk
from ..operators.lexical import bm25_topk
from ..operators.topk import attach_chunks
from ..session import write_and_read


def search(queries, collection, k=schemas.TOP_K, *, mode="dense", lexical=None, nprobe=8):
    """Ranked chunk ids for embedded queries.

    `collection` is a table with vectors or an `IvfIndex`, which is searched
    approximately. `mode` is `dense`, `lexical` or `hybrid`; the last two need
    a BM25 index or scan.
    """
    if isinstance(collection, IvfIndex):
        def dense(_, batch, n):
            return ivf_topk(collection, batch, n, nprobe=nprobe)
    else:
        dense = dense_topk
    if mode == "dense":
        return dense(collection, queries, k)
    if mode == "lexical":
        return bm25_topk(lexical, queries, k)
    if mode == "hybrid":
        return hybrid_topk(collection, lexical, queries, k, dense=dense)
    raise ValueError(f"unknown mode {mode}")


def retrieve(
    requests: DataFrame, collection, model_factory, *, aliases: DataFrame | None = None,
    k=schemas.TOP_K, **options,
) -> DataFrame:
    """Requests to ranked chunks with their columns.

    `requests` has `query_id` and `query`, and optionally `mp` and `ministry`.
    A member is expanded to all its spellings where `aliases` is given.
    """
    rows = requests
    if aliases is not None and "mp" in rows.columns and "names" not in rows.columns:
        rows = resolve_requests(rows, aliases)
    if options.get("mode") != "lexical":
        # Stored, so that the model sees each query once, whatever reads the vectors.
        rows = write_and_read(embed_queries(rows, model_factory), "queries")
    chunks = collection.collection if isinstance(collection, IvfIndex) else collection
    return attach_chunks(search(rows, collection, k, **options), chunks.drop("embedding", "cell"))


def retrieve_one(query, collection: DataFrame, model_factory, *, k=schemas.TOP_K, mp=None, ministry=None, aliases=None) -> DataFrame:
    """The chunks for one request given as values, in rank order.

    The vector is made on the driver; a member is expanded to all its spellings
    where `aliases` is given. Nothing is stored on the way.
    """
    names = [mp] if mp else []
    if mp and aliases is not None:
        request = collection.sparkSession.createDataFrame([(0, query, mp, ministry)], "query_id int, query string, mp string, ministry string")
        names = resolve_requests(request, aliases).first()["names"]
    vector = np.asarray(model_factory()([schemas.QUERY_PREFIX + query]), dtype=np.float64)[0]
    length = np.sqrt((vector * vector).sum())
    vector = (vector / length if length > 0 else vector).astype(np.float32)
    return nearest_chunks(collection, vector, k, names=names, ministry=ministry).drop("embedding").orderBy("rank").limit(k)


def run_eval(cases: DataFrame, collection, model_factory, *, aliases: DataFrame, k=schemas.TOP_K, latency=None, **options):
    """Scores and judged chunks of all cases, unfiltered and filtered, as one batch.

    `latency` (`query_id`, `latency_ms`), measured by whoever sends single
    requests, is carried into the scores and from there into summary and report.
    """
    requests = ev.eval_requests(ev.effective_expected(cases, aliases))
    judged = ev.judge(requests, retrieve(requests, collection, model_factory, k=k, **options))
    return ev.score_retrieval(requests, judged, latency), judged
