"""Dense top-k for a table of queries that is too large for one block.

If each query asks for some cells, queries and chunks are packed, some thousand rows
to one row, and joined on the cell by shuffle. A task scores the pairs of packed rows
it is given as matrices. A cell that is asked for more than others is dealt out by
adaptive skew handling, as are its packed rows.

If each query asks for all, the queries are cut into groups and the collection into
stripes, and every group meets every stripe in a task of its own, which keeps the
group's best rows while the stripe goes by. Queries with filters are scored against the
rows that pass, found by an index of the group's names. A group has a bounded size, and the stripe
is read in batches; a query is sent to as many tasks as there are stripes, a chunk to
as many as there are groups, both about the square root of the number of tasks.

So neither queries nor chunks pass through the driver, and the number of jobs doesn't
depend on the number of queries.
"""

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .topk import BestRows, Filters, fold_batch, fold_parts, found_schema, rank_by_score

# Bytes of vectors and filter columns in one packed row.
PACKED_BYTES = 4 << 20
# Bytes of vectors in one group of queries, as Spark holds them.
GROUP_BYTES = 4 << 20
# Entries of the score matrix of a group held at once by a task.
GROUP_CELLS = 1_000_000
# Parts into which the queries of one cell are dealt before they are packed.
SPREAD = 16


def pack(rows: DataFrame, key, *, most=1 << 16) -> DataFrame:
    """(key, packed): runs of rows with one key as Arrow messages, without the key."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            room = max(1, min(most, PACKED_BYTES * batch.num_rows // max(batch.nbytes, 1)))
            of_row = batch.column(key).to_numpy(zero_copy_only=False)
            heads = [0, *(np.nonzero(of_row[1:] != of_row[:-1])[0] + 1).tolist(), batch.num_rows]
            batch = batch.drop_columns([key])
            keys, packed = [], []
            for first, last in zip(heads[:-1], heads[1:]):
                for start in range(first, last, room):
                    sink = pa.BufferOutputStream()
                    piece = batch.slice(start, min(room, last - start))
                    with pa.ipc.new_stream(sink, piece.schema) as writer:
                        writer.write_batch(piece)
                    keys.append(int(of_row[first]))
                    packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(packed, pa.binary())], names=["key", "packed"])

    return rows.mapInArrow(run, "key int, packed binary")


def _read(packed):
    # One batch was written; large ones stay in one piece.
    return pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks().to_batches()[0]


def _block(rows):
    """The vectors of query rows and their filters."""
    vectors = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).astype(np.float64)
    filters = rows.select([c for c in rows.schema.names if c in ("names", "ministry")])
    return vectors, Filters.of_rows(filters.to_pylist() or [{}] * rows.num_rows)


def paired_topk(chunks: DataFrame, queries: DataFrame, k, score, *, block, cell_col=None, probes_col=None) -> DataFrame:
    """As `dense_topk`, for any number of queries; `score(data, batch)` scores a batch for the vectors of a block."""
    fields = [f.name for f in queries.schema if f.name != probes_col]
    if not {"names", "ministry"} & set(fields):
        chunks = chunks.drop("members", "ministry")
    if not cell_col:
        return rank_by_score(_grid_scores(chunks, queries.select(*fields), k, score, block), k)
    id_type, chunk_id_type = queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
    asked = queries.select(*fields, F.explode(probes_col).alias("key"))
    asked = asked.repartition("key", F.pmod(F.xxhash64("query_id"), F.lit(SPREAD))).sortWithinPartitions("key")
    blocks = pack(asked, "key", most=block).withColumnRenamed("packed", "block")
    # As many numbers as the index has cells.
    probed = [r[0] for r in queries.select(F.explode(probes_col)).distinct().collect()]
    pieces = pack(chunks.where(F.col(cell_col).isin(probed)).withColumnRenamed(cell_col, "key").sortWithinPartitions("key"), "key")
    arrow_id, arrow_chunk_id = to_arrow_type(id_type), to_arrow_type(chunk_id_type)

    def run(batches):
        for batch in batches:
            for piece, packed in zip(batch.column("packed"), batch.column("block")):
                rows = _read(packed)
                vectors, limits = _block(rows)
                best = BestRows(rows.num_rows, k)
                chunk = _read(piece)
                fold_batch(best, limits, chunk, score({"vectors": vectors, "cell_col": None}, chunk))
                yield best.to_batch(rows.column("query_id").to_pylist(), arrow_id, arrow_chunk_id)

    # Spark takes packed rows for small ones and would send a side through the driver.
    found = pieces.hint("merge").join(blocks, "key").select("packed", "block").mapInArrow(run, found_schema(id_type, chunk_id_type))
    return rank_by_score(found, k)


def _grid_scores(chunks: DataFrame, queries: DataFrame, k, score, block) -> DataFrame:
    """The best `k` rows per query and stripe, where every query of a stored table asks for all chunks."""
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, width = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    room = max(1, GROUP_BYTES // max(4 * (width or 0), 1))
    groups = max(-(-total // room), min(isqrt(tasks), -(-total // block)), 1)
    stripes = -(-tasks // groups)

    def dealt(rows, side, mine, other, cell):
        """Rows of one side in a column of their own, once for every number of the other side."""
        rows = rows.select(mine.cast("int").alias("mine"), F.struct(*rows.columns).alias(side))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"))
        return rows.select(cell.alias("cell"), side)

    asked = dealt(
        queries, "query", F.pmod(F.monotonically_increasing_id(), F.lit(groups)), stripes, F.col("mine") * stripes + F.col("other"))
    held = dealt(chunks, "chunk", F.pmod(F.xxhash64("chunk_id"), F.lit(stripes)), groups, F.col("other") * stripes + F.col("mine"))
    met = asked.unionByName(held, allowMissingColumns=True)
    met = met.repartitionById(groups * stripes, "cell").sortWithinPartitions(F.col("query").isNull()).select("query", "chunk")
    id_type, chunk_id_type = queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
    arrow_id, arrow_chunk_id = to_arrow_type(id_type), to_arrow_type(chunk_id_type)

    def side(batch, name):
        column = batch.column(name)
        return pa.RecordBatch.from_struct_array(column.filter(column.is_valid()))

    def run(batches):
        first, group = [], None
        for batch in batches:
            rows, chunk = side(batch, "query"), side(batch, "chunk")
            if rows.num_rows:
                first.append(rows)
            if not chunk.num_rows or not first:
                continue
            if group is None:
                # All queries stand before the first chunk.
                rows = pa.Table.from_batches(first).combine_chunks().to_batches()[0]
                group = (*_block(rows), rows.column("query_id").to_pylist(), BestRows(rows.num_rows, k))
            vectors, limits, ids, best = group
            fold_parts(best, chunk, wanted(vectors, limits, chunk) if limits.active else scored(vectors, chunk))
        if group is not None:
            yield group[3].to_batch(group[2], arrow_id, arrow_chunk_id)

    def wanted(vectors, limits, chunk):
        """The queries of each filter against the rows that pass it, and no others."""
        for number, passed in limits.matches(chunk):
            mine = limits.queries[number]
            for rows, index, scores in scored(vectors[mine], chunk.take(pa.array(passed))):
                yield mine[rows], passed[index], scores

    def scored(vectors, chunk):
        """Few queries at a time, so that all rows of a batch are ranked together."""
        step = max(1, GROUP_CELLS // chunk.num_rows)
        for start in range(0, len(vectors), step):
            for rows, index, scores in score({"vectors": vectors[start: start + step], "cell_col": None}, chunk):
                yield rows + start, index, scores

    return met.mapInArrow(run, found_schema(id_type, chunk_id_type))
