"""Rendezvous hashing of stable record keys over weighted shards.

Every shard gets a pseudo-random number from the record's key and its own id;
the record goes to the shard with the largest weighted number. A shard's number
does not depend on the other shards, so adding one moves only the records it
wins, and removing one moves only the records it held. A heavier shard wins in
proportion to its weight. Assignment is a projection: no shuffle, no state.

Slots number the rows of a shard without gaps. Each input partition numbers its
own rows; counts per (shard, partition) give the offsets. No shard is ever
gathered in one task, however large it is.

Defined results: a null key is a key of its own. Rows with equal keys, copies
included, share a shard and get slots of their own. A null text has one byte
less than nothing to store: size 1, checksum 0. An empty table gives no rows.
Columns of the input keep their names; those named like an output are replaced.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_read

SEED = 17


def weighted_number(key: Column, shard: int, weight=1.0, seed=SEED) -> Column:
    """The number of `shard` for a key: -weight / ln(u), with u uniform in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(seed), F.lit(shard)), 11)
    uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(-float(weight)) / F.log(uniform)


def shard_of(key: Column, shards, weights=None, seed=SEED) -> Column:
    """The shard that wins `key` among `shards`, a sequence of ids."""
    weights = weights or {}
    numbers = [
        F.struct(weighted_number(key, shard, weights.get(shard, 1.0), seed).alias("number"), F.lit(-shard).alias("shard"))
        for shard in shards
    ]
    return (-F.greatest(*numbers)["shard"]).cast("int") if len(numbers) > 1 else F.lit(shards[0]).cast("int")


def assign_shards(df: DataFrame, key="doc_id", shards=16, weights=None, seed=SEED) -> DataFrame:
    """Add `shard`, and `grown_shard` for one shard more, to every row."""
    ids = list(range(shards))
    return df.withColumns({
        "shard": shard_of(F.col(key), ids, weights, seed),
        "grown_shard": shard_of(F.col(key), [*ids, shards], weights, seed),
    })


def number_slots(df: DataFrame, by="shard") -> DataFrame:
    """Add `slot`, a number from 0 without gaps within each value of `by`.

    Rows are stored with the partition they came from and their place in it, so
    that both stay the same for counts and numbers.
    """
    rows = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    rows = write_and_read(rows, "shards")
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(by, "_part").orderBy("_at"))
    return (
        rows.withColumn("_local", local).join(offsets, [by, "_part"])
        .withColumn("slot", (F.col("_before") + F.col("_local") - 1).cast("long"))
        .drop("_at", "_part", "_local", "_before")
    )


def shard_sizes(text: Column) -> dict:
    """Size in UTF-8 bytes plus one, and the checksum, of a text column."""
    plain = F.coalesce(text, F.lit(""))
    return {
        "size": (F.octet_length(plain) + 1).cast("long"),
        "text_crc32": F.crc32(F.encode(plain, "UTF-8")).cast("long"),
    }


def shard_table(docs: DataFrame, shards=16, weights=None) -> DataFrame:
    """One row per document: where it goes, and its slot there."""
    rows = assign_shards(docs.select("doc_id", "text"), shards=shards, weights=weights)
    narrow = rows.withColumns(shard_sizes(F.col("text"))).drop("text").withColumn("law", F.lit("key"))
    return number_slots(narrow).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path, key="doc_id", shards=16, weights=None):
    """Write `df` as one folder per shard."""
    assign_shards(df, key, shards, weights).drop("grown_shard").write.partitionBy("shard").parquet(path)
