"""Extraction reports and collection statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx

# Bytes per dense value with index, per sparse row, per metadata row.
DENSE_FACTOR = 4 * 2.5
SPARSE_BYTES = 300
META_BYTES = 500
# Extractions under this many characters count as empty; the preview's length, and its text for none.
EMPTY_CHARS = 50
PREVIEW_CHARS = 300
NO_PREVIEW = "(empty)"


def storage_bytes(rows: Column, dim, has_sparse) -> Column:
    """Estimated bytes of a collection, whole bytes."""
    sparse = has_sparse if isinstance(has_sparse, Column) else F.lit(has_sparse)
    dense = rows * F.lit(dim * DENSE_FACTOR)
    return (dense + F.when(sparse, rows * SPARSE_BYTES).otherwise(0) + rows * META_BYTES).cast("bigint")


def storage_label(size: Column) -> Column:
    return tx.size_label(F.floor(size / 1024))


def collection_stats(chunks: DataFrame, by="collection", *, dim=schemas.EMBED_DIM, has_sparse=False) -> DataFrame:
    """Rows, sparse flag and estimated storage per collection."""
    size = storage_bytes(F.col("chunks"), dim, has_sparse)
    sparse = has_sparse if isinstance(has_sparse, Column) else F.lit(has_sparse)
    return (
        chunks.groupBy(by).agg(F.count("*").alias("chunks"))
        .select(by, "chunks", sparse.alias("has_sparse"), size.alias("bytes"), storage_label(size).alias("storage"))
    )


def collection_total(stats: DataFrame) -> DataFrame:
    """One row over all collections."""
    total = F.sum("bytes")
    return stats.agg(
        F.count("*").alias("collections"), F.sum("chunks").alias("chunks"),
        total.alias("bytes"), storage_label(total).alias("storage"),
    )


def extraction_rows(extractions: DataFrame) -> DataFrame:
    """Per-extraction measures; a failed run keeps its error and counts zero."""
    text = F.coalesce("text", F.lit(""))
    return extractions.withColumns({
        "char_count": F.length(text), "word_count": tx.word_count(text), "is_empty": F.length(text) < EMPTY_CHARS,
        "preview": F.when(text == "", F.lit(NO_PREVIEW)).otherwise(F.substring(text, 1, PREVIEW_CHARS)),
    }).drop("text")


def engine_totals(rows: DataFrame) -> DataFrame:
    """Per-engine aggregates over the runs without an error."""
    return rows.where(F.coalesce("error", F.lit("")) == "").groupBy("engine").agg(
        F.count("*").alias("runs"),
        F.sum("time_sec").alias("total_time"),
        F.avg("time_sec").alias("avg_time"),
        F.sum("char_count").alias("chars"),
        F.avg("mem_peak_delta_mb").alias("avg_mem"),
        F.count_if(F.col("char_count") < EMPTY_CHARS).alias("empty"),
    )


def compare_existing(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """New extractions next to existing ones of the same stem: `existing` has `stem`, `existing_chars`."""
    diff = F.col("char_count") - F.col("existing_chars")
    sign = F.when(diff > 0, "+").otherwise("")
    return rows.join(existing, "stem").select(
        "engine", "stem", "existing_chars", "char_count", diff.alias("diff"),
        F.concat(sign, diff.cast("string")).alias("diff_text"),
    )
