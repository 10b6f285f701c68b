"""Ingestion over tables that share one layout.

Chunks, vectors and the collection are bucketed on the chunk id, into the same
number of buckets. Text is shuffled once, when new chunks are put into their
buckets; from then on, what is pending, which chunk and vector belong together
and what the collection lacks are found bucket by bucket. No later step shuffles
a text or a vector, and a run over a grown corpus costs scans, not sorts of all
that was stored before.

Every step appends what its table lacks in one job, whose commit is all or
nothing, so a run that was cut short continues where the tables stand. An id is
stored once: a later text under the same id is skipped. For a collection by
cell or ministry use `plans.ingest.index_step`.
"""

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators import incremental as inc
from ..operators.chunking import corpus_to_chunks
from ..operators.embedding import embed
from .ingest import Counts

COLLECTION = schemas.CHUNKS.fields + [schemas.EMBEDDINGS["embedding"]]
TABLES = {"chunks": schemas.CHUNKS.fields, "vectors": schemas.EMBEDDINGS.fields, "collection": COLLECTION}


def create_tables(spark: SparkSession, name, *, buckets, location=None):
    """Empty tables `name_chunks`, `name_vectors` and `name_collection`, under `location` if given."""
    for table, fields in TABLES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        place = f"LOCATION '{location}/{table}'" if location else ""
        spark.sql(
            f"CREATE TABLE {name}_{table} ({columns}) USING parquet "
            f"CLUSTERED BY (chunk_id) SORTED BY (chunk_id) INTO {int(buckets)} BUCKETS {place}")


def buckets_of(spark: SparkSession, name) -> int:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}_chunks").where("col_name = 'Num Buckets'")
    return int(rows.first()["data_type"])


def add_chunks(corpus: DataFrame, name, *, counts: Counts | None = None, **chunking) -> DataFrame:
    """Cut documents and store the chunks that are new."""
    spark = corpus.sparkSession
    counts = Counts() if counts is None else counts
    made = inc.thin_copies(counts.watch(corpus_to_chunks(corpus, **chunking), "total"))
    placed = made.repartition(buckets_of(spark, name), "chunk_id").dropDuplicates(["chunk_id"])
    _append(inc.pending_chunks(placed, spark.table(f"{name}_chunks")), name, "chunks", counts)
    return spark.table(f"{name}_chunks")


def pending_texts(spark: SparkSession, name, counts: Counts) -> DataFrame:
    """Id and text of the stored chunks without a vector."""
    texts = counts.watch(spark.table(f"{name}_chunks").select("chunk_id", "text"), "total")
    return inc.pending_chunks(texts, spark.table(f"{name}_vectors"))


def embed_pending(spark: SparkSession, name, model_factory, *, counts: Counts | None = None, **options) -> DataFrame:
    """Embed the stored chunks that have no vector yet."""
    counts = Counts() if counts is None else counts
    _append(embed(pending_texts(spark, name, counts), model_factory, **options), name, "vectors", counts)
    return spark.table(f"{name}_vectors")


def left_to_index(spark: SparkSession, name, counts: Counts) -> DataFrame:
    """Chunks with their vectors that the collection lacks."""
    ready = counts.watch(inc.with_embeddings(spark.table(f"{name}_chunks"), spark.table(f"{name}_vectors")), "total")
    return inc.unindexed_chunks(ready, spark.table(f"{name}_collection"))


def index_pending(spark: SparkSession, name, *, counts: Counts | None = None) -> DataFrame:
    """Append the embedded chunks that the collection lacks."""
    counts = Counts() if counts is None else counts
    _append(left_to_index(spark, name, counts), name, "collection", counts)
    return spark.table(f"{name}_collection")


def _append(rows: DataFrame, name, table, counts: Counts):
    """Add rows to their buckets. A task holds rows of its own buckets, so it writes few files."""
    rows = rows.select(*[f.name for f in TABLES[table]])
    counts.watch(rows, "new").write.insertInto(f"{name}_{table}")
    counts.done()
