"""Exact dense top-k under metadata filters.

A batch of chunks is scored against a block of queries with one matrix product.
The scan reads ids, vectors and filter columns only; `attach_chunks` fetches the
wide columns of the winners afterwards.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import write_and_read
from .paired import paired_topk
from .topk import SCORE_DIGITS, by_filter, scan_scores, scan_topk

# Queries scored per pass over the collection.
QUERY_BLOCK = 1024
# Entries of the score matrix held at once by a task.
SCORE_CELLS = 1_000_000


def dense_topk(
    chunks: DataFrame, queries: DataFrame, k=schemas.TOP_K, *, block=QUERY_BLOCK, cell_col=None, probes_col=None
) -> DataFrame:
    """The `k` chunks with the largest inner product for every query.

    `chunks` has `chunk_id` and `embedding`, plus `members` and `ministry`
    when queries carry filters. `queries` has `query_id` and `embedding`, and
    optionally `names` (any of them in `members`) and `ministry` (equal); a
    null or empty filter is not checked. Filters apply before ranking. Ties
    go to the smaller id. Returns `(query_id, chunk_id, score, rank)`.

    With `cell_col`, a query sees only the chunks whose cell is in its array
    `probes_col`.
    """
    fields = [c for c in ("query_id", "embedding", "names", "ministry", probes_col) if c in queries.columns]
    queries = queries.select(*fields).where(F.col("embedding").isNotNull())
    columns = [c for c in ("chunk_id", "embedding", "members", "ministry", cell_col) if c in chunks.columns]
    source = chunks.select(*columns).where(F.col("embedding").isNotNull())

    def search(rows):
        pruned = source
        probed = {}
        if cell_col:
            for number, row in enumerate(rows):
                for cell in row[probes_col]:
                    probed.setdefault(cell, []).append(number)
            pruned = source.where(F.col(cell_col).isin(sorted(probed)))
        payload = {
            "vectors": np.asarray([row["embedding"] for row in rows], dtype=np.float64),
            "cell_col": cell_col,
            "probed": {cell: np.asarray(numbers) for cell, numbers in probed.items()},
        }
        return scan_topk(pruned, rows, queries.schema["query_id"].dataType, k, _inner_products, payload)

    few = queries.limit(block + 1).collect()
    if len(few) <= block:
        return by_filter(few, search)
    # Stored, so that whatever makes the vectors runs once.
    return paired_topk(
        source, write_and_read(queries, "queries"), k, _inner_products, block=block, cell_col=cell_col, probes_col=probes_col)


def nearest_chunks(chunks: DataFrame, vector, k=schemas.TOP_K, *, names=(), ministry=None) -> DataFrame:
    """The best `k` chunks for one literal vector, with all columns, `score` and `rank`.

    One job finds them, a scan that ends in an ordered limit; reading the result
    is a scan for their ids, which reach the files as a predicate.
    """
    row = {"query_id": 0, "embedding": list(map(float, vector)), "names": list(names or ()), "ministry": ministry}
    columns = [c for c in ("chunk_id", "embedding", "members", "ministry") if c in chunks.columns]
    payload = {"vectors": np.asarray([row["embedding"]], dtype=np.float64), "cell_col": None, "probed": {}}
    source = chunks.select(*columns).where(F.col("embedding").isNotNull())
    scored = scan_scores(source, [row], T.IntegerType(), k, _inner_products, payload)
    best = scored.orderBy(F.desc("score"), "chunk_id").limit(k).select("chunk_id", "score").collect()
    # Should rows share an id, one of them gives the columns.
    winners = chunks.where(F.col("chunk_id").isin([r["chunk_id"] for r in best])).dropDuplicates(["chunk_id"])

    def of_id(values, kind):
        pairs = [F.lit(x) for r, value in zip(best, values) for x in (r["chunk_id"], value)]
        return F.element_at(F.create_map(*pairs), F.col("chunk_id")) if pairs else F.lit(None).cast(kind)

    return winners.withColumns({
        "score": of_id([r["score"] for r in best], "double"), "rank": of_id(range(1, len(best) + 1), "int")})


def _inner_products(data, batch):
    """Scores of a batch, in one part, or in one part per probed cell."""
    import pyarrow.compute as pc

    vectors = data["vectors"]
    dim = vectors.shape[1]
    column = batch.column("embedding")
    if pc.min_max(pc.list_value_length(column)).as_py() != {"min": dim, "max": dim}:
        raise ValueError(f"every vector must have length {dim}")
    matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim).astype(np.float64)
    if not data["cell_col"]:
        parts = [(np.arange(len(vectors)), None)]
    else:
        cell = batch.column(data["cell_col"]).to_numpy(zero_copy_only=False)
        parts = [(data["probed"][c], np.nonzero(cell == c)[0]) for c in np.unique(cell) if c in data["probed"]]
    for queries, index in parts:
        index = np.arange(batch.num_rows) if index is None else index
        step = max(SCORE_CELLS // max(len(queries), 1), 1)
        for start in range(0, len(index), step):
            some = index[start : start + step]
            # Adding zero turns a negative zero into a plain one.
            yield queries, some, np.round(vectors[queries] @ matrix[some].T, SCORE_DIGITS) + 0.0
