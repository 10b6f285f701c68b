"""Writers. Spark's commit protocol stands where a temp file and rename would."""

from pyspark.sql import DataFrame

from .. import schemas


def write_chunks(chunks: DataFrame, path, *, mode="overwrite"):
    chunks.write.mode(mode).parquet(path)


def append_embeddings(embeddings: DataFrame, path):
    """Add rows; nothing already written is read or rewritten."""
    embeddings.write.mode("append").parquet(path)


def write_collection(collection: DataFrame, path, *, mode="append", partition_by=()):
    """Vector collection. Partition by `cell` for probing or by `ministry` for filters.

    Rebalancing gathers the rows of a partition value into few files; AQE
    splits a value too large for one task.
    """
    if partition_by:
        collection = collection.hint("rebalance", *partition_by)
    collection.write.mode(mode).partitionBy(*partition_by).parquet(path)


def drop_and_write_collection(collection: DataFrame, path, *, partition_by=()):
    write_collection(collection, path, mode="overwrite", partition_by=partition_by)


def write_metadata(questions: DataFrame, links: DataFrame, root):
    """The two metadata tables as plain Parquet."""
    questions.write.mode("overwrite").parquet(f"{root}/questions")
    links.write.mode("overwrite").parquet(f"{root}/question_mps")


def save_metadata_bucketed(questions: DataFrame, links: DataFrame, *, database="default", buckets=200):
    """The two tables bucketed on the question key, so their join needs no shuffle."""
    for df, name in ((questions, "questions"), (links, "question_mps")):
        (
            df.write.mode("overwrite")
            .bucketBy(buckets, *schemas.QUESTION_KEY)
            .sortBy(*schemas.QUESTION_KEY)
            .saveAsTable(f"{database}.{name}")
        )


def write_alias_map(aliases: DataFrame, path):
    aliases.select("canonical", "aliases").write.mode("overwrite").json(path)
