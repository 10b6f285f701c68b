"""Approximate dense top-k through an inverted file (Jégou et al., 2011).

Vectors are assigned to the nearest of a fixed number of centroids and the
collection is written partitioned by that cell. A query reads the cells nearest
to it: partition pruning drops the rest of the table, and within the cells the
exact scorer runs, with every file split its own task. A cell that holds a large
share of the collection is therefore many tasks, never one.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import write_and_read
from .dense import QUERY_BLOCK, dense_topk

# Vectors that one local centre stands for when the centroids are placed.
SUMMARY_ROWS = 16
# Entries of the distance matrix held at once by a task.
DISTANCE_CELLS = 4_000_000


@dataclass
class IvfIndex:
    """The collection with its `cell` column, and the centroid table."""

    collection: DataFrame
    centroids: DataFrame


def _summaries(seed):
    """Reduce each Arrow batch of vectors to weighted local centres."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("embedding")
            if batch.num_rows == 0:
                continue
            points = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
            points = points[np.isfinite(points).all(axis=1)]
            if len(points) == 0:
                continue
            picked = np.random.default_rng(seed).choice(len(points), -(-len(points) // SUMMARY_ROWS), replace=False)
            centres = points[picked]
            for _ in range(2):
                nearest = np.empty(len(points), dtype=np.int64)
                step = max(DISTANCE_CELLS // len(centres), 1)
                for at in range(0, len(points), step):
                    part = points[at : at + step]
                    nearest[at : at + step] = ((centres ** 2).sum(axis=1) - 2 * part @ centres.T).argmin(axis=1)
                weights = np.bincount(nearest, minlength=len(centres))
                sums = np.zeros_like(centres)
                np.add.at(sums, nearest, points)
                used = weights > 0
                centres, weights = sums[used] / weights[used, None], weights[used]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(centres), type=pa.list_(pa.float64())), pa.array(weights.astype(np.float64))], names=["embedding", "weight"])

    return run


def train_centroids(chunks: DataFrame, cells, *, seed=42, max_iter=10) -> DataFrame:
    """Centroids `(cell, embedding)` by k-means over all vectors.

    Each task reduces its vectors to local centres in one pass, one for every
    `SUMMARY_ROWS` of them and weighted by their number; k-means runs over
    these. Every vector counts, whatever their number. There are no more cells
    than different vectors.
    """
    vectors = chunks.where(F.col("embedding").isNotNull()).select("embedding")
    local = vectors.mapInArrow(_summaries(seed), "embedding array<double>, weight double")
    if local.limit(2 * cells).count() < 2 * cells:
        # Too few vectors to be reduced, some `2 * SUMMARY_ROWS` for each cell.
        finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
        local = vectors.where(finite).select(F.col("embedding").cast("array<double>").alias("embedding"), F.lit(1.0).alias("weight"))
    local = write_and_read(local.withColumn("features", array_to_vector("embedding")).drop("embedding"), "centres")
    cells = max(min(cells, local.select("features").distinct().limit(cells).count()), 1)
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, initSteps=2, weightCol="weight").fit(local)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    schema = T.StructType([
        T.StructField("cell", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
    ])
    return chunks.sparkSession.createDataFrame(rows, schema)


def nearest_cells(vectors: DataFrame, centroids: DataFrame, n) -> DataFrame:
    """Add `cells`, the `n` cells nearest to each vector. Map-only.

    The number of cells is a parameter of the index, so the centroids are small.
    """
    rows = sorted(centroids.collect(), key=lambda r: r["cell"])
    numbers = np.asarray([r["cell"] for r in rows], dtype=np.int32)
    matrix = vectors.sparkSession.sparkContext.broadcast(np.asarray([r["embedding"] for r in rows], dtype=np.float64))
    n = min(n, len(rows))

    @F.pandas_udf("array<int>")
    def nearest(column: pd.Series) -> pd.Series:
        centres = matrix.value
        lengths = (centres ** 2).sum(axis=1)
        step = max(DISTANCE_CELLS // len(centres), 1)
        out = []
        for start in range(0, len(column), step):
            points = np.stack(column.iloc[start : start + step].to_numpy()).astype(np.float64)
            # The squared length of the point is the same for every centroid.
            distance = lengths - 2 * points @ centres.T
            closest = np.argpartition(distance, n - 1, axis=1)[:, :n]
            order = np.argsort(np.take_along_axis(distance, closest, axis=1), axis=1, kind="stable")
            out.extend(numbers[np.take_along_axis(closest, order, axis=1)])
        return pd.Series(out, index=column.index, dtype=object)

    return vectors.withColumn("cells", nearest("embedding"))


def assign_cells(chunks: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add the nearest cell of every chunk. Rows without a vector drop out."""
    present = chunks.where(F.col("embedding").isNotNull())
    return nearest_cells(present, centroids, 1).withColumn("cell", F.col("cells")[0]).drop("cells")


def build_ivf(chunks: DataFrame, cells, **training) -> IvfIndex:
    centroids = train_centroids(chunks, cells, **training)
    return IvfIndex(assign_cells(chunks, centroids), centroids)


def write_ivf(index: IvfIndex, path, *, mode="overwrite") -> IvfIndex:
    """Store the collection partitioned by cell, and the centroids.

    Rebalancing gathers a cell's rows so it has few files, and splits a cell
    too large for one task.
    """
    index.collection.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/collection")
    index.centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return read_ivf(index.collection.sparkSession, path)


def read_ivf(spark, path) -> IvfIndex:
    return IvfIndex(spark.read.parquet(f"{path}/collection"), spark.read.parquet(f"{path}/centroids"))


def ivf_topk(index: IvfIndex, queries: DataFrame, k=schemas.TOP_K, *, nprobe=8, block=QUERY_BLOCK) -> DataFrame:
    """As `dense_topk`, over the `nprobe` cells nearest to each query.

    A query that finds fewer than `k` chunks there, as under a filter that its
    near cells don't meet, is searched again over twice as many cells, until it
    has `k` or no cell is left.
    """
    waiting = queries.where(F.col("embedding").isNotNull())
    cells, done = index.centroids.count(), None
    while True:
        probing = nearest_cells(waiting, index.centroids, nprobe)
        found = dense_topk(index.collection, probing, k, block=block, cell_col="cell", probes_col="cells")
        if nprobe >= cells:
            return found if done is None else done.unionByName(found)
        found = write_and_read(found, "probed")
        full = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        waiting = write_and_read(waiting.join(full, "query_id", "left_anti"), "waiting")
        kept = found.join(full, "query_id", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        if waiting.isEmpty():
            return done
        nprobe *= 2
