"""BM25 ranking (Robertson and Zaragoza, 2009) over chunk text.

Two forms give the same result. A stored index holds postings sorted by term,
so queries with rare terms read only the row groups of these; queries with
common terms scan its tokenised documents. Without an index the chunk table is
scanned, and no token is shuffled: a first pass counts in how many chunks each
query term occurs, a second scores and keeps the best rows per task.

A common term costs work in proportion to its occurrences and nothing else: no
join or grouping is keyed by term alone.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text as tx
from ..functions.batches import parts
from .topk import SCORE_DIGITS, by_filter, in_blocks, scan_topk

# The usual BM25 parameters.
K1 = 1.2
B = 0.75

# A stored index gathers postings up to this many per chunk of the collection,
# where the caller doesn't say otherwise. Either way the result is the same.
GATHERED_SHARE = 0.25
# Queries scored per pass over the collection.
QUERY_BLOCK = 1024
# Entries of the score matrix, and of the matches behind it, held at once by a task.
SCORE_CELLS = 500_000
# Terms of a batch that are looked up together.
TERMS = 1 << 17


@dataclass
class ChunkScan:
    """A chunk table as a source of term counts."""

    chunks: DataFrame

    def statistics(self, terms):
        """Number of chunks, mean length, and chunks per query term, in one pass."""
        words = _documents(self.chunks).select("terms")
        wanted = self.chunks.sparkSession.sparkContext.broadcast(terms)

        def count(batches):
            import pyarrow as pa

            value_set = pa.array(wanted.value, type=pa.string())
            found = np.zeros(len(value_set), dtype=np.int64)
            chunks = length = 0
            for batch in batches:
                for part in parts(batch, "terms", TERMS):
                    rows, numbers, lengths = _lookup(part.column("terms"), value_set)
                    chunks, length = chunks + part.num_rows, length + int(lengths.sum())
                    pairs = np.unique(rows * len(value_set) + numbers)
                    found += np.bincount(pairs % max(len(value_set), 1), minlength=len(value_set))
            present = np.nonzero(found)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([-2, -1, *present], type=pa.int32()), pa.array([chunks, length, *found[present]], type=pa.int64())],
                names=["term_no", "n"],
            )

        counted = words.mapInArrow(count, "term_no int, n bigint").groupBy("term_no").agg(F.sum("n").alias("n"))
        totals = {row["term_no"]: row["n"] for row in counted.collect()}
        chunks = totals.pop(-2, 0)
        length = totals.pop(-1, 0)
        return chunks, length / max(chunks, 1), totals

    def hits(self, terms, chunks, found):
        """`(chunk_id, terms)` and metadata; every term once per occurrence."""
        return _documents(self.chunks)


@dataclass
class Bm25Index:
    """Postings `(term, chunk_id, tf, dl)`, `(term, df)`, one-row stats, and the
    documents `(chunk_id, terms)` with their metadata."""

    postings: DataFrame
    frequencies: DataFrame
    stats: DataFrame
    documents: DataFrame
    gathered_share: float = GATHERED_SHARE

    def statistics(self, terms):
        stats = self.stats.first()
        numbers = self._numbered(terms)
        found = self.frequencies.join(F.broadcast(numbers), "term").select("term_no", "df").collect()
        return stats["n"], stats["avgdl"], {row["term_no"]: row["df"] for row in found}

    def hits(self, terms, chunks, found):
        """What to score: matching postings gathered by chunk, or all documents.

        Rare terms touch few postings, which are cheap to gather. Where the
        terms of a block match more postings than a share of the chunks, a scan
        of the documents reads more but shuffles nothing.
        """
        if sum(found.values()) > self.gathered_share * chunks:
            return self.documents
        matching = self.postings.join(F.broadcast(self._numbered(terms)), "term")
        gathered = matching.groupBy("chunk_id").agg(
            F.first("dl").alias("dl"), F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs")
        )
        metadata = self.documents.drop("terms")
        return gathered.join(metadata, "chunk_id") if len(metadata.columns) > 1 else gathered

    def _numbered(self, terms):
        rows = [(i, t) for i, t in enumerate(terms)]
        return self.postings.sparkSession.createDataFrame(rows, "term_no int, term string")

    def write(self, path):
        """Store the index. Range partitioning on (term, chunk) splits long postings lists.

        Documents are tokenised and stored first; the rest is built from them.
        """
        spark = self.documents.sparkSession
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        built = _index_of(spark.read.parquet(f"{path}/documents"))
        ranged = built.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")
        ranged.write.mode("overwrite").parquet(f"{path}/postings")
        frequencies = _frequencies(spark.read.parquet(f"{path}/postings"))
        frequencies.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/frequencies")
        built.stats.write.mode("overwrite").parquet(f"{path}/stats")
        return read_bm25_index(spark, path)


def _documents(chunks):
    metadata = [c for c in ("members", "ministry") if c in chunks.columns]
    # A chunk without text counts as one without terms, in either form.
    terms = F.coalesce(tx.terms(F.col("text")), F.array().cast("array<string>"))
    return chunks.select("chunk_id", terms.alias("terms"), *metadata)


def bm25_scan(chunks: DataFrame) -> ChunkScan:
    return ChunkScan(chunks)


def bm25_index(chunks: DataFrame) -> Bm25Index:
    """Postings, term frequencies and corpus statistics of a chunk table."""
    return _index_of(_documents(chunks))


def _index_of(documents):
    postings = _postings(documents)
    stats = documents.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    return Bm25Index(postings, _frequencies(postings), stats, documents)


def _frequencies(postings):
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def _postings(documents):
    """Terms counted per document. All tokens of a document are in one row, so
    this needs no shuffle."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in (part for batch in batches for part in parts(batch, "terms", TERMS)):
            column = batch.column("terms")
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = pc.dictionary_encode(column.flatten())
            size = max(len(words.dictionary), 1)
            rows = np.repeat(np.arange(len(lengths)), lengths)
            pairs, tf = np.unique(rows * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = pairs // size
            yield pa.RecordBatch.from_arrays(
                [
                    words.dictionary.take(pa.array(pairs % size)),
                    batch.column("chunk_id").take(pa.array(row)),
                    pa.array(lengths[row], type=pa.int32()),
                    pa.array(tf, type=pa.int32()),
                ],
                names=["term", "chunk_id", "dl", "tf"],
            )

    schema = T.StructType([
        T.StructField("term", T.StringType()), documents.schema["chunk_id"],
        T.StructField("dl", T.IntegerType()), T.StructField("tf", T.IntegerType()),
    ])
    return documents.select("chunk_id", "terms").mapInArrow(count, schema)


def read_bm25_index(spark, path, *, gathered_share=GATHERED_SHARE) -> Bm25Index:
    tables = [spark.read.parquet(f"{path}/{t}") for t in ("postings", "frequencies", "stats", "documents")]
    return Bm25Index(*tables, gathered_share)


def bm25_topk(source, queries: DataFrame, k=schemas.TOP_K, *, block=QUERY_BLOCK) -> DataFrame:
    """The `k` best chunks per query: `(query_id, chunk_id, score, rank)`.

    `source` is a `ChunkScan` or a `Bm25Index`. `queries` has `query_id` and
    `query`, and may carry the filters of `dense_topk`. Corpus statistics cover
    the whole collection even so. Chunks that share no term are not returned.
    A scan tokenises the collection twice per block of queries; for many
    blocks, or repeated use, store an index.
    """
    filters = [c for c in ("names", "ministry") if c in queries.columns]
    queries = queries.select("query_id", F.array_distinct(tx.terms(F.col("query"))).alias("terms"), *filters)

    def search(rows):
        terms = sorted({t for row in rows for t in row["terms"] or ()})
        chunks, mean_length, found = source.statistics(terms)
        number = {t: i for i, t in enumerate(terms)}
        idf = np.zeros(len(terms))
        for term_no, df in found.items():
            idf[term_no] = np.log(1 + (chunks - df + 0.5) / (df + 0.5))
        matching = source.hits(terms, chunks, found)

        def scan(part):
            # Queries of each term, term after term.
            users = [[] for _ in terms]
            for q, row in enumerate(part):
                for t in row["terms"] or ():
                    users[number[t]].append(q)
            payload = {
                "terms": terms,
                "idf": idf,
                "avgdl": mean_length,
                "queries": len(part),
                "starts": np.cumsum([0] + [len(u) for u in users]),
                "users": np.asarray([q for u in users for q in u], dtype=np.int64),
            }
            return scan_topk(matching, part, queries.schema["query_id"].dataType, k, _bm25, payload, cut=lambda batch: parts(batch, "terms", TERMS))

        return by_filter(rows, scan)

    return in_blocks(queries, block, search)


def _lookup(column, value_set):
    """Row and term numbers of the tokens in the value set, and all row lengths."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = pc.fill_null(pc.index_in(column.flatten(), value_set=value_set), -1).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    known = numbers >= 0
    return rows[known], numbers[known].astype(np.int64), lengths


def _bm25(data, batch):
    """Scores of a batch in parts of bounded size; no shared term scores `-inf`."""
    import pyarrow as pa

    value_set = pa.array(data["terms"], type=pa.string())
    rows, numbers, lengths = _lookup(batch.column("terms"), value_set)
    width, vocabulary = data["queries"], max(len(value_set), 1)
    if "tfs" in batch.schema.names:
        lengths = batch.column("dl").to_numpy(zero_copy_only=False).astype(np.float64)
        tf, pairs = batch.column("tfs").flatten().to_numpy(zero_copy_only=False), rows * vocabulary + numbers
    else:
        pairs, tf = np.unique(rows * vocabulary + numbers, return_counts=True)
    rows, numbers = pairs // vocabulary, pairs % vocabulary
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[rows] / data["avgdl"])) * data["idf"][numbers]

    everyone = np.arange(width)
    uses = np.diff(data["starts"])[numbers]
    per_row = np.bincount(rows, weights=uses, minlength=1).max()
    step = max(SCORE_CELLS // int(max(width, per_row)), 1)
    bounds = np.searchsorted(rows, np.arange(0, batch.num_rows + step, step))
    for part, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
        if low == high:
            continue
        index = np.arange(part * step, min((part + 1) * step, batch.num_rows))
        # Every match counts for each query that uses the term.
        fan_out = uses[low:high]
        offset = np.arange(fan_out.sum()) - np.repeat(np.cumsum(fan_out) - fan_out, fan_out)
        users = data["users"][np.repeat(data["starts"][numbers[low:high]], fan_out) + offset]
        place = users * len(index) + np.repeat(rows[low:high] - part * step, fan_out)
        size = width * len(index)
        sums = np.bincount(place, weights=np.repeat(gain[low:high], fan_out), minlength=size)
        # A present term has a positive weight, so zero means no shared term.
        scores = np.where(sums > 0, np.round(sums, SCORE_DIGITS), -np.inf)
        yield everyone, index, scores.reshape(width, len(index))
