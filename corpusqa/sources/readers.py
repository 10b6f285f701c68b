"""Readers. All take paths any Hadoop file system can open."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def conform(df: DataFrame, schema: T.StructType = schemas.CORPUS) -> DataFrame:
    """Select the fields of `schema`; fields the table lacks become nulls.

    A string `members` column is kept as a string, since both forms occur.
    """
    columns = []
    for field in schema.fields:
        if field.name not in df.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif field.name == "members" and isinstance(df.schema["members"].dataType, T.StringType):
            columns.append(F.col("members"))
        else:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return df.select(*columns)


def first_rows(df: DataFrame, limit) -> DataFrame:
    """The first rows of a Parquet scan in the order of files and of rows in them.

    Rows are counted per file, and every file gives those that are still within
    the limit: no text is sorted or gathered. One row per file is all that moves.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = at.groupBy("_file").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    files = files.where(F.col("_before") < limit).select("_file", (F.lit(limit) - F.col("_before")).alias("_room"))
    return at.join(F.broadcast(files), "_file").where(F.col("_index") < F.col("_room")).drop("_file", "_index", "_room")


def read_corpus(spark: SparkSession, path, *, rename=None, limit=None, order_cols=None, partitions=None) -> DataFrame:
    """Read question documents from Parquet.

    `rename` maps source columns to corpus fields. `limit` keeps the first
    documents in `order_cols` order, by default the order of rows in the files.
    `partitions` deals the rows out anew, for a small file that can't be split.
    """
    df = spark.read.parquet(path)
    if limit is not None:
        df = df.orderBy(*order_cols).limit(limit) if order_cols else first_rows(df, limit)
    if partitions is not None:
        df = df.repartition(partitions)
    for source, target in (rename or {}).items():
        df = df.withColumnRenamed(source, target)
    return conform(df)


def _read_by_term(spark, glob, entry):
    """Read one JSON array per term directory; the directory name is the term."""
    raw = (
        spark.read.schema(entry)
        .option("multiLine", True)
        .option("mode", "DROPMALFORMED")
        .option("ignoreCorruptFiles", True)
        .json(glob)
    )
    lok = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)/[^/]+$", 1)
    return (
        raw.withColumn("lok", F.nullif(lok, F.lit("")).cast("int"))
        # One task reads one multi-line file, so ids grow in file order.
        .withColumn("pos", F.monotonically_increasing_id())
        .where(F.col("lok").isNotNull())
    )


def read_registry(spark: SparkSession, glob) -> DataFrame:
    """Member registry: `(lok, pos, mpNo, mpName)` from `.../{term}/members.json`."""
    return _read_by_term(spark, glob, schemas.MEMBER_ENTRY).select("lok", "pos", "mpNo", "mpName")


def read_ministries(spark: SparkSession, glob) -> DataFrame:
    """Ministry registry: `(lok, minName)` from `.../{term}/ministries.json`."""
    return _read_by_term(spark, glob, schemas.MINISTRY_ENTRY).select("lok", "minName")


def read_eval_cases(spark: SparkSession, path) -> DataFrame:
    """Evaluation cases; `mp`, `ministry` and `notes` may be missing."""
    cases = spark.read.schema(schemas.EVAL_CASE).option("multiLine", True).json(path)
    return cases.withColumn("notes", F.coalesce("notes", F.lit("")))


def read_alias_map(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.ALIASES).json(path)
