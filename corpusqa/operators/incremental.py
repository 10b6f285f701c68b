"""Work left to do: joins against what is already embedded or indexed."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_chunks(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks that have no embedding yet."""
    return chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti")


def thin_copies(df: DataFrame, key="chunk_id") -> DataFrame:
    """Keep one row per key of each Arrow batch, so that a key that many rows share is few rows in a shuffle."""

    def run(batches):
        for batch in batches:
            coded = batch.column(key).dictionary_encode(null_encoding="encode")
            first = np.unique(coded.indices.to_numpy(), return_index=True)[1]
            yield batch.take(np.sort(first)) if len(first) < batch.num_rows else batch

    return df.mapInArrow(run, df.schema)


def unindexed_chunks(chunks: DataFrame, collection: DataFrame, *, granularity="chunk") -> DataFrame:
    """Chunks not in the collection yet.

    `granularity="document"` skips every chunk of a document that has any
    chunk indexed; by chunk, a half-indexed document is completed.
    """
    if granularity == "document":
        # A document has many chunks; one row for each is enough.
        return chunks.join(collection.select("qa_id").distinct(), "qa_id", "left_anti")
    if granularity != "chunk":
        raise ValueError(f"unknown granularity {granularity}")
    return chunks.join(collection.select("chunk_id"), "chunk_id", "left_anti")


def with_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks paired with their vectors; those without a vector drop out.

    `embeddings` holds one row per chunk id, as the embedding step writes it.
    """
    return chunks.join(embeddings.select("chunk_id", "embedding"), "chunk_id")


def run_counts(chunks: DataFrame, done: DataFrame, *, key="chunk_id") -> DataFrame:
    """One row: total, skipped and new chunks of a run."""
    known = done.select(key).distinct().withColumn("_known", F.lit(True))
    return chunks.select(key).join(known, key, "left").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_known")).alias("skipped"),
        F.count_if(F.col("_known").isNull()).alias("new"),
    )
