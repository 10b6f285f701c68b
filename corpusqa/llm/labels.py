"""Which labelled rows teach a classifier."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column, folds, fold) -> Column:
    """Whether the checksum of a key as text falls into the fold that teaches nothing; null counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == fold


def teaching_labels(labels: DataFrame, label, key="doc_id", folds=3, fold=1, most=None) -> DataFrame:
    """(key, label) of all rows, or of at most about `most` rows of each class, chosen by a hash of the key.

    The larger of several labels of a key counts; null keys and labels are left out.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key), folds, fold))
    known = known.groupBy(key).agg((F.max(label) > 0).cast("int").alias("label"))
    if most is None:
        return known
    sizes = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    share = F.lit(1.0)
    for value in (0, 1):
        share = F.when(F.col("label") == value, F.lit(most / max(sizes.get(value, 0), most))).otherwise(share)
    hashed = F.xxhash64(F.col(key), F.lit(29)).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return known.where(hashed <= share)
