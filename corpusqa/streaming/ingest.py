"""Restartable ingestion as a Structured Streaming job.

Arriving corpus files are read in bounded micro-batches; each is chunked,
embedded and written as its own partition of the collection. The partition is
overwritten, not appended to, so a batch repeated after a failure replaces
itself and the result is exactly once.

The ids of all chunks seen are keyed state of the stream. A batch looks up its
own ids there and reads nothing that earlier batches wrote, so its cost depends
on its size alone. The state belongs to the checkpoint and is as many ids as
the collection has chunks: `session.CLUSTER_CONF` keeps it on disk.
"""

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from .. import schemas
from ..operators import incremental as inc
from ..operators.chunking import corpus_to_chunks
from ..operators.embedding import embed
from ..plans.ingest import read_or_empty
from ..sources.readers import conform

COLLECTION = T.StructType(schemas.CHUNKS.fields + [schemas.EMBEDDINGS["embedding"]])
STORED = T.StructType(COLLECTION.fields + [T.StructField("batch_id", T.LongType())])


class StreamCounts(StreamingQueryListener):
    """Chunks that the batches of a run were given, stored and skipped, from their progress reports.

    Each report is of a batch that has run, with no scan of its own. A batch
    that runs again after a failure is counted by the run that finishes it.
    """

    def __init__(self):
        self.batches = []
        self._over = threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get("chunks")
        if seen is not None and seen["total"]:
            new = sum(op.numRowsUpdated for op in event.progress.stateOperators)
            self.batches.append({"batch_id": event.progress.batchId, "total": seen["total"], "new": new, "skipped": seen["total"] - new})

    def onQueryTerminated(self, event):
        self._over.set()

    def total(self, timeout=60) -> dict:
        """Sums over all batches, once the run is over."""
        if not self._over.wait(timeout):
            raise TimeoutError("the run has not ended")
        return {name: sum(b[name] for b in self.batches) for name in ("total", "new", "skipped")}


def store_batch(chunks: DataFrame, batch_id: int, target, model_factory) -> None:
    """Embed chunks and write them as `target/batch_id=N`."""
    ready = embed(chunks, model_factory, keep=schemas.CHUNKS.fieldNames())
    ready.select(*COLLECTION.fieldNames()).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")


def ingest_batch(corpus: DataFrame, batch_id: int, target, model_factory, *, skip_known=True, **chunking) -> None:
    """Chunk, embed and store one batch of documents outside a stream; known ids are read from earlier batches."""
    chunks = corpus_to_chunks(corpus, **chunking).dropDuplicates(["chunk_id"])
    if skip_known:
        # Only earlier batches count, so that a repeated batch is whole again.
        known = read_or_empty(corpus.sparkSession, target, STORED).where(F.col("batch_id") < batch_id)
        chunks = inc.unindexed_chunks(chunks, known)
    store_batch(chunks, batch_id, target, model_factory)


def ingest_stream(
    spark: SparkSession, source, source_schema, target, checkpoint, model_factory, *,
    rename=None, files_per_batch=200, counts: StreamCounts | None = None, **chunking,
):
    """Start a run over all files not ingested yet; it stops when they are done.

    Returns the streaming query. The next run continues from the checkpoint,
    which belongs to the target. `counts` is filled while the run goes on.
    """
    stream = spark.readStream.schema(source_schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    for old, new in (rename or {}).items():
        stream = stream.withColumnRenamed(old, new)
    chunks = corpus_to_chunks(conform(stream), **chunking).observe("chunks", F.count(F.lit(1)).alias("total"))
    fresh = inc.thin_copies(chunks).dropDuplicates(["chunk_id"])
    if counts is not None:
        spark.streams.addListener(counts)

    def each(batch, batch_id):
        store_batch(batch, batch_id, target, model_factory)

    return fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_collection(spark: SparkSession, target) -> DataFrame:
    return spark.read.schema(STORED).parquet(target)
