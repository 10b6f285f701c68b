"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of fixed size. Distinct blocks are sorted and numbered:
the number is the block's name. Names of adjacent blocks form pairs, distinct
pairs are sorted and numbered in turn, and so on until every text has one name.
Equal texts have equal names and different texts of the same depth have different
ones, for names stand for sorted values and not for hashes.

Texts travel once, in the sort of the first level. Within one Arrow slice equal
blocks are sent once, under a code of the slice, so a block or a pair that a
third of all texts share sends one row per slice and no group is ever gathered:
the sorted rows are numbered as they stream by. Values are spread over tasks by
hash and sorted within; a name is the task's number and the rank there. Every
level is written to the shared folder before it is used, so a lost executor
cannot change names that are in use.

Defined results: null is the empty text. Of equal texts the row with the largest
key stays; null keys come before all others, and of rows with equal keys the one
read last stays. An empty table gives no rows. Other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import write_and_read
from .words import slices, text_bytes

BLOCK_BYTES = 2048
ODD = -1  # partner of a last block without one

# What a level writes: slices of texts that go on, values to name, texts that are done.
SLICE, VALUE, DONE = 0, 1, 2


def _schema(id_type):
    texts = [
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("rows", T.ArrayType(T.LongType())),
        T.StructField("digests", T.ArrayType(T.StringType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("codes", T.ArrayType(T.IntegerType())),
    ]
    value = [
        T.StructField("code", T.IntegerType()), T.StructField("block", T.BinaryType()),
        T.StructField("left", T.LongType()), T.StructField("right", T.LongType()),
    ]
    done = [
        T.StructField("id", id_type), T.StructField("row", T.LongType()), T.StructField("digest", T.StringType()),
        T.StructField("name", T.LongType()),
    ]
    return T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("slice", T.LongType()), *texts, *value, *done])


def _batch(schema, num_rows, **columns):
    """A record batch with the given columns; the others are null."""
    arrays = []
    for field in schema:
        values = columns.get(field.name)
        if values is None:
            values = pa.nulls(num_rows, field.type)
        arrays.append(values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _one(values):
    """One row that holds all of `values` as a list."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), values)


def _slice_batch(schema, number, ids, rows, digests, sizes, codes):
    return _batch(
        schema, 1, kind=[SLICE], slice=[number], ids=_one(ids), rows=_one(rows), digests=_one(digests),
        sizes=_one(sizes.astype(np.int32)), codes=_one(codes.astype(np.int32)))


def _cut(schema, block_bytes):
    """Texts to blocks: one row per slice of texts, one per distinct block of it."""

    def run(batches):
        part, seen, number = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for texts in slices(batch):
                data, offsets = text_bytes(texts.column("text"))
                sizes = np.maximum(1, -(-np.diff(offsets) // block_bytes))
                first = np.cumsum(sizes) - sizes
                starts = np.repeat(offsets[:-1], sizes) + block_bytes * (np.arange(sizes.sum()) - np.repeat(first, sizes))
                bounds = np.append(starts, offsets[-1]).astype(np.int64)
                blocks = pa.Array.from_buffers(
                    pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
                coded = blocks.dictionary_encode()
                raw = memoryview(np.ascontiguousarray(data))
                digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
                rows = (part << 40) + seen + np.arange(texts.num_rows)
                group = (part << 32) + number
                yield _slice_batch(schema, group, texts.column("id"), rows, digests, sizes, coded.indices.to_numpy())
                n = len(coded.dictionary)
                yield _batch(schema, n, kind=[VALUE] * n, slice=[group] * n, code=np.arange(n, dtype=np.int32), block=coded.dictionary)
                seen, number = seen + texts.num_rows, number + 1

    return run


def _pair(schema):
    """Put names in place of codes; texts of one name are done, the others are paired."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values for name in ("ids", "rows", "digests", "sizes", "codes", "names")}
                sizes = row["sizes"].to_numpy().astype(np.int64)
                names = row["names"].to_numpy()[row["codes"].to_numpy()]
                first = np.cumsum(sizes) - sizes
                done = sizes == 1
                kept = pa.array(done)
                if done.any():
                    n = int(done.sum())
                    yield _batch(
                        schema, n, kind=[DONE] * n, id=row["ids"].filter(kept), row=row["rows"].filter(kept),
                        digest=row["digests"].filter(kept), name=names[first[done]])
                if done.all():
                    continue
                sizes, first = sizes[~done], first[~done]
                halves = (sizes + 1) // 2
                at = np.repeat(first, halves) + 2 * (np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves))
                inside = at + 1 < np.repeat(first + sizes, halves)
                left = names[at]
                right = np.where(inside, names[np.minimum(at + 1, len(names) - 1)], ODD)
                pairs, codes = np.unique(np.stack([left, right], axis=1), axis=0, return_inverse=True)
                group, rest, n = batch.column("slice")[i].as_py(), pa.array(~done), len(pairs)
                yield _slice_batch(
                    schema, group, row["ids"].filter(rest), row["rows"].filter(rest), row["digests"].filter(rest),
                    halves, codes.reshape(-1))
                yield _batch(
                    schema, n, kind=[VALUE] * n, slice=[group] * n, code=np.arange(n, dtype=np.int32),
                    left=np.ascontiguousarray(pairs[:, 0]), right=np.ascontiguousarray(pairs[:, 1]))

    return run


def name_values(values: DataFrame, columns) -> DataFrame:
    """Number the distinct values of `columns` in sorted order: (slice, code, name)."""
    ordered = values.select("slice", "code", *columns).repartition(*columns).sortWithinPartitions(*columns)
    out = T.StructType([
        T.StructField("slice", T.LongType()), T.StructField("code", T.IntegerType()), T.StructField("name", T.LongType())])

    def number(batches):
        import pyarrow.compute as pc

        name, last = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            fresh = np.zeros(n, dtype=bool)
            for column in columns:
                values = batch.column(column)
                fresh[1:] |= pc.not_equal(values.slice(1), values.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            head = [batch.column(c)[0].as_py() for c in columns]
            fresh[0] = last is not None and head != last
            names = name + np.cumsum(fresh)
            name, last = int(names[-1]), [batch.column(c)[n - 1].as_py() for c in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column("slice"), batch.column("code"), pa.array(names)], names=["slice", "code", "name"])

    return ordered.mapInArrow(number, out)


def text_identities(df: DataFrame, key="doc_id", text="text", block_bytes=BLOCK_BYTES) -> DataFrame:
    """(id, row, digest, depth, name): rows with equal texts have equal depth and name."""
    source = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = _schema(source.schema["id"].dataType)
    arrow = to_arrow_schema(schema)
    level = write_and_read(source.mapInArrow(_cut(arrow, block_bytes), schema), "blocks")
    longest = level.where(F.col("kind") == SLICE).agg(F.max(F.array_max("sizes"))).first()[0] or 1
    columns, done = ["block"], []
    for depth in range((longest - 1).bit_length() + 1):
        named = name_values(level.where(F.col("kind") == VALUE), columns)
        by_code = F.sort_array(F.collect_list(F.struct("code", "name")))
        of_slice = named.groupBy("slice").agg(by_code.alias("_n")).select("slice", F.col("_n.name").alias("names"))
        texts = level.where(F.col("kind") == SLICE).select("slice", "ids", "rows", "digests", "sizes", "codes")
        level = write_and_read(texts.join(of_slice, "slice").mapInArrow(_pair(arrow), schema), "names")
        done.append(level.where(F.col("kind") == DONE).select("id", "row", "digest", F.lit(depth).alias("depth"), "name"))
        columns = ["left", "right"]
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_duplicates(df: DataFrame, key="doc_id", text="text", block_bytes=BLOCK_BYTES) -> DataFrame:
    """One row per document: the key that stays, the group's size, whether it stays, and the text's SHA-256."""
    named = text_identities(df, key, text, block_bytes)
    groups = named.groupBy("depth", "name").agg(
        F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # Stored, so that both sides of the join are shuffled and a hot group can be split.
    groups = write_and_read(groups, "groups")
    return named.join(groups, ["depth", "name"]).select(
        F.col("id").alias(key), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"))
