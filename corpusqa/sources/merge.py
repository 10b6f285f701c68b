"""Metadata tables that grow by keyed merges.

The two tables lie under one root, cut by term and session. A merge writes the
partitions it touches anew, with old and new rows, as one more generation, and
then one small table that says which generation holds each partition. That table
is the merge: it is written last and by one commit, so readers see all of a merge,
in both tables, or nothing of it. A run that was cut short leaves files that no
version names, and the next run overwrites them.

A question replaces the stored one with its key, and its links replace those of
that question. Questions without a type have no key and are added, as in a build
from scratch; repeating a merge therefore adds them again. Null terms and sessions
are partitions like any other.
"""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import entities as ent
from ..session import observed, write_and_read

PARTITION = ["lok_no", "session_no"]
TABLES = {"questions": schemas.QUESTIONS, "question_mps": schemas.LINKS}
VERSIONS = "version long, lok_no int, session_no int, generation long"


def _versions(spark: SparkSession, root) -> DataFrame:
    try:
        return spark.read.schema(VERSIONS).parquet(f"{root}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def _current(spark: SparkSession, root):
    """The last committed version and its partitions, of which there is one row per term and session."""
    versions = _versions(spark, root)
    last = versions.agg(F.max("version")).first()[0] or 0
    return last, versions.where(F.col("version") == last).drop("version")


def _stored(spark: SparkSession, root, name, partitions: DataFrame) -> DataFrame:
    """The rows of a table in the generations that `partitions` names."""
    schema = TABLES[name]
    generations = [r[0] for r in partitions.select("generation").distinct().collect()]
    if not generations:
        return spark.createDataFrame([], schema)
    # Each by itself: a generation without rows has no partitions to be found by. There are no more than partitions.
    parts = [spark.read.schema(schema).parquet(f"{root}/{name}/generation={g}").withColumn("generation", F.lit(g)) for g in sorted(generations)]
    rows = reduce(DataFrame.unionByName, parts)
    named = F.broadcast(partitions.select(*[F.col(c).alias(f"at_{c}") for c in (*PARTITION, "generation")]))
    on = [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in PARTITION] + [F.col("generation") == F.col("at_generation")]
    return rows.join(named, on, "left_semi").select(*schema.fieldNames())


def read_metadata(spark: SparkSession, root) -> tuple[DataFrame, DataFrame]:
    """`questions` and `question_mps` of the last committed version."""
    _, partitions = _current(spark, root)
    return tuple(_stored(spark, root, name, partitions) for name in TABLES)


def merge_metadata(corpus: DataFrame, registry: DataFrame, order_cols, root) -> dict:
    """Merge documents into the tables under `root`; how many rows of each came in, and how many they replaced."""
    spark = corpus.sparkSession
    names = ent.canonical_names(registry)
    fields = ["lok_no", "session_no", "ques_no", "type", "date", "ministry", "subject", "members"]
    # Gathered by partition once, here: both tables then write few files without a shuffle of their own.
    latest = ent.latest_questions(corpus, order_cols).select(*fields).hint("rebalance", *PARTITION)
    latest = write_and_read(latest, "latest")
    fresh = {"questions": ent.questions_of(latest), "question_mps": ent.links_of(latest, names)}
    last, partitions = _current(spark, root)
    generation = last + 1

    touched = write_and_read(latest.select(*PARTITION).distinct(), "touched")
    at = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in PARTITION]
    partitions = write_and_read(partitions, "partitions")
    before = partitions.alias("old").join(F.broadcast(touched.alias("new")), at, "left_semi")
    keys = latest.select(*schemas.QUESTION_KEY).where(F.col("type").isNotNull())
    # Null in none of these keys, so plain equality will do, which sorts four columns and not eight.
    same = [F.col(f"old.{c}") == F.col(f"new.{c}") for c in ent.SORT_KEY]
    counts = {}
    for name, rows in fresh.items():
        # Counted by the write itself.
        found, written = Observation(), Observation()
        old = _stored(spark, root, name, before).observe(found, F.count(F.lit(1)).alias("n"))
        kept = old.alias("old").join(keys.alias("new"), same, "left_anti").hint("rebalance", *PARTITION)
        both = kept.withColumn("is_new", F.lit(False)).unionByName(rows.withColumn("is_new", F.lit(True)))
        both = both.observe(written, F.count(F.lit(1)).alias("n"), F.count_if("is_new").alias("new")).drop("is_new")
        path = f"{root}/{name}/generation={generation}"
        both.write.mode("overwrite").partitionBy(*PARTITION).parquet(path)
        counts[name] = observed(written, "new")
        counts[f"replaced_{name}"] = observed(found, "n") - (observed(written, "n") - counts[name])
    commit = partitions.alias("old").join(F.broadcast(touched.alias("new")), at, "left_anti").unionByName(
        touched.withColumn("generation", F.lit(generation).cast("long")))
    _commit(commit.withColumn("version", F.lit(generation).cast("long")), f"{root}/versions")
    return counts


def _commit(partitions: DataFrame, path):
    """Name the partitions of a version, all in one file."""
    partitions.select("version", *PARTITION, "generation").coalesce(1).write.mode("append").parquet(path)
