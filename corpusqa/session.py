"""Session helpers: shared scratch space and size-checked broadcasts."""

import functools
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings for a cluster, on top of its own sizing of executors. Scans of vectors
# hold a constant amount of memory per task, so larger splits mean fewer partial
# results; Arrow batches count rows, so documents of megabytes want fewer of them.
# The ids that a stream has seen are kept on the executors' disks, not in their heap.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "512MB",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus=8, **conf):
    """A session for tests and the benchmark. On a cluster, use the one it gives."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpusqa")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_root() -> str:
    """One temporary folder for sessions of this process on one machine."""
    return tempfile.mkdtemp(prefix="corpusqa-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder of the cluster.

    Intermediate tables go there rather than to executor-local storage, so a
    lost executor costs a re-read and not a recomputation.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        # The setting can't be changed in a running session.
        root = _local_root()
    return f"{root.rstrip('/')}/corpusqa-{label}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, label: str, partition_by=()) -> DataFrame:
    """Cut the lineage of `df` with a table in the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def observed(seen: Observation, name) -> int:
    """A count that an action has observed; 0 where Spark dropped the node, as no row could reach it."""
    try:
        return seen.get[name]
    except Py4JJavaError:
        return 0


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark `df` for broadcast if a count shows at most `max_rows` rows.

    Above the bound the frame comes back unmarked, and Catalyst joins it by
    shuffle, with AQE splitting skewed partitions.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
