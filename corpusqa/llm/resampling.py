"""Importance resampling towards a target distribution.

Documents are drawn so that their words resemble those of a target set. Words and
runs of up to `most` words fall into buckets by checksum; what a bucket is worth is
the logarithm of its share in the target over its share in the documents, and a
document weighs the mean over its own. Seeded Gumbel noise on top of the weights
makes the highest scores a sample without replacement.

A text becomes words through one table of 256 bytes, which lower-cases A-Z and
blanks what separates words, and one split of its bytes. The checksum of a run
continues that of the run one word shorter. Tasks count buckets with Counters and
send at most one row per bucket, so corpus counts shuffle nothing that grows with
the texts; counts and gains have as many entries as there are buckets.

Ranks come from one distributed sort of (score, key) and the number of rows in each
sorted partition: no task and no driver sees all rows.

Defined results: null and empty texts have no feature and weight 0; a null key
counts as empty text in the noise and comes last among ties. Rows with equal keys
and texts have equal scores and follow each other in any order. Where nothing can be
drawn all ranks are null. An empty target counts as no features. Empty tables give
no rows. Other columns are kept, except for those named like the results.
"""

import math
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import write_and_read
from .words import slices

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
# Columns beside a caller's between two steps.
PART, START = "corpusqa part", "corpusqa start"

# Lower-cases A-Z, keeps digits, letters and bytes beyond ASCII, blanks the rest.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def features(text: bytes, most=1, buckets=BUCKETS):
    """How many words a text has, and the bucket of every run of at most `most` words."""
    words = text.translate(TABLE).split()
    if most == 1:
        # Words repeat, checksums needn't.
        found = Counter()
        for word, n in Counter(words).items():
            found[zlib.crc32(word) % buckets] += n
        return len(words), found
    sums = [zlib.crc32(word) for word in words]
    found = Counter(s % buckets for s in sums)
    for longer in range(1, most):
        sums = [zlib.crc32(b" " + word, s) for s, word in zip(sums, words[longer:])]
        found.update(s % buckets for s in sums)
    return len(words), found


def bucket_counts(texts: DataFrame, text="text", most=1, buckets=BUCKETS) -> dict:
    """How often each bucket occurs in all texts."""

    def run(batches):
        found = Counter()
        for batch in batches:
            for part in slices(batch):
                for t in part.column(0).cast(pa.binary()):
                    found.update(features(t.as_py() or b"", most, buckets)[1])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["bucket", "n"])

    counted = texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket long, n long")
    # One row per bucket at most.
    return {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict, target: dict, buckets=BUCKETS) -> list:
    """What each bucket is worth, in thousandths."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log(float(target.get(b, 0) + 1) * s_all / (float(corpus.get(b, 0) + 1) * t_all)))
        for b in range(buckets)]


def noise(key: Column, seed=SEED) -> Column:
    """Gumbel noise from a hash of seed and key, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, text="text", most=1, buckets=BUCKETS) -> DataFrame:
    """Add `n_words`, `n_features` and `weight` to every row, without the text."""
    worth = docs.sparkSession.sparkContext.broadcast(
        gains(bucket_counts(docs, text, most, buckets), bucket_counts(target, text, most, buckets), buckets))
    results = ("n_words", "n_features", "weight")
    kept = [f for f in docs.schema if f.name not in (*results, text)]
    numbered = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(f"`{text}`").alias("text"))
    out = T.StructType([*kept, *[T.StructField(name, T.LongType()) for name in results]])
    arrow = to_arrow_schema(out)

    def run(batches):
        gain = worth.value
        for batch in batches:
            for part in slices(batch):
                rows = []
                for t in part.column("text").cast(pa.binary()):
                    words, found = features(t.as_py() or b"", most, buckets)
                    n = found.total()
                    rows.append((words, n, sum(gain[b] * c for b, c in found.items()) // n if n else 0))
                columns = [part.column(f"c{i}") for i in range(len(kept))] + [pa.array(column, pa.int64()) for column in zip(*rows)]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return numbered.mapInArrow(run, out)


def resample(docs: DataFrame, target: DataFrame, key="doc_id", text="text", most=1, buckets=BUCKETS,
             least_words=LEAST_WORDS, percent=PERCENT, seed=SEED) -> DataFrame:
    """Every row with `n_features`, `weight`, `score`, and its `rank` if it is drawn; without the text."""
    docs = docs.drop("score", "rank")
    scored = weigh(docs, target, text, most, buckets).withColumn("score", F.col("weight") + noise(F.col(f"`{key}`"), seed))
    scored = write_and_read(scored, "scores")
    fit = F.col("n_words") >= least_words
    many = percent * scored.where(fit).count() // 100
    # Sorted partitions, numbered on; the hash parts rows with one key and one score. Its order is that of nothing else.
    rows = scored.where(fit).withColumn("rank", F.monotonically_increasing_id())
    rows = rows.orderBy(F.col("score").desc(), F.col(f"`{key}`").asc_nulls_last(), F.xxhash64("rank"))
    rows = write_and_read(rows.withColumn("rank", F.monotonically_increasing_id()), "ranks")
    # monotonically_increasing_id holds the partition above 33 bits, and the place in it below.
    rows = rows.withColumn(PART, F.shiftright("rank", 33))
    # One row per partition of the sort.
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(PART).count().select(PART, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(START))
    rows = rows.join(F.broadcast(starts), PART)
    rank = F.col(START) + F.col("rank").bitwiseAND((1 << 33) - 1) + 1
    ranked = rows.withColumn("rank", F.when(rank <= many, rank)).drop(PART, START)
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("n_words")


def resample_table(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: features, weight, score, and the rank of those drawn."""
    return resample(docs.select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")
