"""Documents to collection in three restartable steps, each ending in a table.

Every step appends only what its output table lacks, so a run that was cut
short, or one over a grown corpus, continues where the tables stand.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import incremental as inc
from ..operators.approximate import assign_cells
from ..operators.chunking import corpus_to_chunks
from ..operators.embedding import embed
from ..session import observed
from ..sources import writers


def read_or_empty(spark: SparkSession, path, schema) -> DataFrame:
    """The table at `path`, or an empty one of this schema before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def chunk_step(corpus: DataFrame, path, **chunking) -> DataFrame:
    writers.write_chunks(corpus_to_chunks(corpus, **chunking), path)
    return corpus.sparkSession.read.schema(schemas.CHUNKS).parquet(path)


class Counts(dict):
    """Rows a step was given, wrote and skipped: filled by the write itself, with no scan of its own."""

    def __init__(self):
        self._seen = {name: Observation() for name in ("total", "new")}

    def watch(self, df: DataFrame, name) -> DataFrame:
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("n"))

    def done(self):
        self.update({name: observed(seen, "n") for name, seen in self._seen.items()})
        self["skipped"] = self["total"] - self["new"]


def embed_step(chunks: DataFrame, path, model_factory, *, counts: Counts | None = None, **options) -> DataFrame:
    """Embed the chunks that have no vector yet; `counts` is filled if given."""
    spark = chunks.sparkSession
    counts = Counts() if counts is None else counts
    done = read_or_empty(spark, path, schemas.EMBEDDINGS)
    # Copies that share an id are embedded once, and pairing stays one to one.
    texts = counts.watch(chunks.select("chunk_id", "text"), "total")
    pending = inc.pending_chunks(texts, done).dropDuplicates(["chunk_id"])
    writers.append_embeddings(counts.watch(embed(pending, model_factory, **options), "new"), path)
    counts.done()
    return spark.read.schema(schemas.EMBEDDINGS).parquet(path)


def index_step(
    chunks, embeddings, path, *, centroids=None, granularity="chunk", recreate=False, counts: Counts | None = None,
) -> DataFrame:
    """Append the embedded chunks the collection lacks; with centroids, by cell. `counts` is filled if given."""
    spark = chunks.sparkSession
    counts = Counts() if counts is None else counts
    ready = counts.watch(inc.with_embeddings(chunks, embeddings), "total")
    partition_by = ()
    if centroids is not None:
        ready, partition_by = assign_cells(ready, centroids), ("cell",)
    if recreate:
        writers.drop_and_write_collection(counts.watch(ready.dropDuplicates(["chunk_id"]), "new"), path, partition_by=partition_by)
    else:
        known = read_or_empty(spark, path, ready.schema)
        # Copies that share an id are indexed once.
        left = inc.unindexed_chunks(ready, known, granularity=granularity).dropDuplicates(["chunk_id"])
        writers.write_collection(counts.watch(left, "new"), path, partition_by=partition_by)
    counts.done()
    return spark.read.schema(ready.schema).parquet(path)
