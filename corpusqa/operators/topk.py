"""Top-k over a collection for a batch of queries, shared by dense and BM25 search.

A block of queries is sent to the executors once. Each task walks its share of
the collection in Arrow batches, scores a batch with a few array operations,
and keeps only the best `k` rows per query. Query-chunk pairs are never
materialised, and the shuffle carries `k` rows per query and task whatever the
size of the collection.

Queries beyond one block run block after block, each block's result written to
shared storage before the next starts, so memory never grows with the batch.
"""

from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as tx
from ..session import scratch_path, write_and_read
from .documents import members_filter

# Scores are compared after rounding, as the order of a sum is not fixed.
SCORE_DIGITS = 9
# Above this many result rows the chunk columns come by shuffle join.
MAX_BROADCAST_WINNERS = 1_000_000


def rank_by_score(scored: DataFrame, k, by="query_id", tie="chunk_id") -> DataFrame:
    """Keep the `k` best rows per query. The limit also runs before the shuffle."""
    window = Window.partitionBy(by).orderBy(F.desc("score"), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def attach_chunks(topk: DataFrame, chunks: DataFrame, *, bound=None) -> DataFrame:
    """Join the winners to the columns of the chunk table.

    The winners are stored first, so that the search runs once. While they are
    few they are broadcast and the chunk table is not shuffled. `bound` is an
    upper bound on their number, where the caller knows it and a count can be
    spared. Should rows share an id, one of them gives the columns.
    """
    topk = write_and_read(topk, "topk")
    few = (topk.count() if bound is None else bound) <= MAX_BROADCAST_WINNERS
    mark = F.broadcast if few else (lambda df: df)
    ids = mark(topk.select("chunk_id").distinct())
    found = chunks.join(ids, "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    return found.join(mark(topk), "chunk_id")


def in_blocks(queries: DataFrame, block, search) -> DataFrame:
    """Run `search(rows)` over blocks of at most `block` query rows and unite the results.

    The queries are read once, one partition after another, so that each row is in
    one block whatever its id, and only a partition and two blocks are held.
    """
    rows = queries.toLocalIterator(prefetchPartitions=True)
    block_rows, ahead = list(islice(rows, block)), list(islice(rows, block))
    if not ahead:
        return search(block_rows)
    out = scratch_path(queries.sparkSession, "topk")
    while block_rows:
        search(block_rows).write.mode("append").parquet(out)
        block_rows, ahead = ahead, list(islice(rows, block))
    return queries.sparkSession.read.parquet(out)


def by_filter(rows, search) -> DataFrame:
    """Search the rows that name a ministry apart from the others.

    Their ministries become a predicate of the scan; one row without a ministry
    would take it away from all.
    """
    named = [row for row in rows if row.asDict().get("ministry")]
    others = [row for row in rows if not row.asDict().get("ministry")]
    found = [search(part) for part in (others, named) if part] or [search(rows)]
    return reduce(DataFrame.unionByName, found)


class NameIndex:
    """Many names, looked up in texts together: the windows of the texts that are as long as a name are hashed at once.

    The work grows with the bytes of the texts and the number of different lengths of
    names, not with the number of names. A hit is compared byte by byte.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, names):
        self.names = [name.encode() for name in names]
        by_size = {}
        for number, name in enumerate(self.names):
            by_size.setdefault(len(name), []).append(number)
        self.sizes = []
        for size, numbers in by_size.items():
            spelled = np.frombuffer(b"".join(self.names[i] for i in numbers), dtype=np.uint8).reshape(len(numbers), size)
            hashes = (spelled * self._powers(self.BASE, size)).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.sizes.append((size, hashes[order], np.asarray(numbers)[order]))

    @staticmethod
    def _powers(base, n):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, base, dtype=np.uint64)])[:n]

    def hits(self, texts):
        """(name, text) numbers where an Arrow array of texts holds a name, each pair once."""
        import pyarrow as pa

        texts = texts.cast(pa.large_binary())
        values = texts.to_pylist()
        data = b"".join(values)
        ends = np.cumsum([0, *map(len, values)])
        owner = np.repeat(np.arange(len(values)), np.diff(ends))
        # A window's sum of byte times power, less the power of its start.
        sums = np.r_[np.uint64(0), np.cumsum(np.frombuffer(data, dtype=np.uint8) * self._powers(self.BASE, len(data)))]
        back = self._powers(pow(self.BASE, -1, 1 << 64), len(data))
        room = ends[owner + 1] - np.arange(len(data))
        found = set()
        for size, hashes, numbers in self.sizes:
            if size == 0:
                found.update((int(n), i) for n in numbers for i in range(len(values)))
                continue
            at = np.nonzero(room >= size)[0]
            window = (sums[at + size] - sums[at]) * back[at]
            first, last = np.searchsorted(hashes, window, "left"), np.searchsorted(hashes, window, "right")
            for i in np.nonzero(last > first)[0]:
                text = owner[at[i]]
                found.update((int(n), int(text)) for n in numbers[first[i]: last[i]] if self.names[n] in values[text])
        return sorted(found)


@dataclass
class Filters:
    """The distinct filters of a block, and the number of each query's filter."""

    distinct: list
    of_query: np.ndarray

    @classmethod
    def of_rows(cls, rows):
        seen, numbers = {}, []
        for row in rows:
            values = row if isinstance(row, dict) else row.asDict()
            key = (tuple(values.get("names") or ()), values.get("ministry") or None)
            numbers.append(seen.setdefault(key, len(seen)))
        return cls(list(seen), np.asarray(numbers, dtype=np.int64))

    @property
    def active(self):
        return any(f != ((), None) for f in self.distinct)

    def pushed(self):
        """What all filters agree on as a scan predicate: any of the ministries, where each has one."""
        ministries = sorted({ministry for _, ministry in self.distinct if ministry})
        return F.col("ministry").isin(ministries) if all(m for _, m in self.distinct) else F.lit(True)

    @cached_property
    def queries(self):
        """The numbers of the queries of each filter."""
        order = np.argsort(self.of_query, kind="stable")
        return np.split(order, np.searchsorted(self.of_query[order], np.arange(1, len(self.distinct))))

    @cached_property
    def _lookup(self):
        """An index of all names, the filters of each name, and the filters without names by their ministry."""
        numbers, of_name, of_ministry = {}, [], {}
        for number, (names, ministry) in enumerate(self.distinct):
            for name in dict.fromkeys(names):
                if numbers.setdefault(name, len(numbers)) == len(of_name):
                    of_name.append([])
                of_name[numbers[name]].append(number)
            if not names:
                of_ministry[ministry] = number
        return NameIndex(list(numbers)), of_name, of_ministry

    def matches(self, batch):
        """(filter number, rows) of an Arrow batch, for the filters that let any row pass.

        Conditions run on the distinct values of the batch: the chunks of one
        document repeat its metadata. Filters that nothing matches cost no step.
        """
        import pyarrow.compute as pc

        def distinct(name):
            encoded = batch.column(name).dictionary_encode()
            # The code after the last value stands for null, which passes nothing.
            codes = pc.fill_null(encoded.indices, len(encoded.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            rows = np.split(order, np.searchsorted(codes[order], np.arange(1, len(encoded.dictionary) + 1)))
            return encoded.dictionary, codes, rows

        index, of_name, of_ministry = self._lookup
        members, _, with_members = distinct("members")
        ministries, ministry_of, with_ministry = distinct("ministry")
        place = {value: code for code, value in enumerate(ministries.to_pylist())}
        if None in of_ministry:
            yield of_ministry[None], np.arange(batch.num_rows)
        for ministry, code in place.items():
            if ministry in of_ministry:
                yield of_ministry[ministry], with_ministry[code]
        held = {}
        for name, code in index.hits(members):
            for number in of_name[name]:
                ministry = self.distinct[number][1]
                if ministry is None or ministry in place:
                    held.setdefault(number, set()).add(code)
        for number, codes in held.items():
            rows = np.sort(np.concatenate([with_members[code] for code in codes]))
            if self.distinct[number][1] is not None:
                rows = rows[ministry_of[rows] == place[self.distinct[number][1]]]
            if len(rows):
                yield number, rows

    def gates(self, batch):
        """Boolean matrix, filter number by row of an Arrow batch."""
        out = np.zeros((len(self.distinct), batch.num_rows), dtype=bool)
        for number, rows in self.matches(batch):
            out[number, rows] = True
        return out


class BestRows:
    """The best `k` rows per query seen so far by one task."""

    def __init__(self, queries, k):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.empty((queries, k), dtype=object)

    def merge(self, queries, scores, rows, ids, places):
        """Fold in a block of scores, query by row; `-inf` never enters.

        `rows` are the rows of the batch behind the columns of `scores`, `ids` the
        ids of the batch, and `places` their places in the order of ids: among
        equal scores the smallest ids are kept. Only ids that enter become
        Python objects.
        """
        import pyarrow as pa

        room, top = self.scores[queries, -1], scores.max(axis=1)
        if np.isnan(top).any():
            # A vector that is not a number matches nothing.
            scores = np.where(np.isnan(scores), -np.inf, scores)
            top = scores.max(axis=1)
        for i in np.nonzero((top >= room) & (top > -np.inf))[0]:
            q, row = queries[i], scores[i]
            keep = np.nonzero((row >= room[i]) & (row > -np.inf))[0]
            if len(keep) > self.k:
                cut = np.partition(row[keep], -self.k)[-self.k]
                above, equal = keep[row[keep] > cut], keep[row[keep] == cut]
                room_left = self.k - len(above)
                if len(equal) > room_left:
                    equal = equal[np.argpartition(places[rows[equal]], room_left - 1)[:room_left]]
                keep = np.concatenate([above, equal])
            old = self.scores[q] > -np.inf
            all_scores = np.concatenate([self.scores[q][old], row[keep]])
            new_ids = np.empty(len(keep), dtype=object)
            new_ids[:] = ids.take(pa.array(rows[keep])).to_pylist()
            all_ids = np.concatenate([self.ids[q][old], new_ids])
            pick = sorted(range(len(all_scores)), key=lambda j: (-all_scores[j], all_ids[j]))[: self.k]
            self.scores[q, : len(pick)] = all_scores[pick]
            self.ids[q, : len(pick)] = all_ids[pick]

    def to_batch(self, query_ids, id_type, chunk_id_type):
        import pyarrow as pa

        q, slot = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([query_ids[i] for i in q], type=id_type),
                pa.array(self.ids[q, slot].tolist(), type=chunk_id_type),
                pa.array(self.scores[q, slot], type=pa.float64()),
            ],
            names=["query_id", "chunk_id", "score"],
        )


def fold_batch(best, limits, batch, parts):
    """Fold the scored `parts` of an Arrow batch into `best`, filters applied."""
    if not limits.active:
        return fold_parts(best, batch, parts)
    gates = limits.gates(batch)

    def gated():
        for queries, index, scores in parts:
            gate = gates if index is None else gates[:, index]
            scores[~gate[limits.of_query[queries]]] = -np.inf
            yield queries, index, scores

    return fold_parts(best, batch, gated())


def fold_parts(best, batch, parts):
    """Fold the scored `parts` of an Arrow batch into `best`."""
    import pyarrow.compute as pc

    ids, places = batch.column("chunk_id"), None
    for queries, index, scores in parts:
        if places is None:
            order = pc.array_sort_indices(ids).to_numpy()
            places = np.empty(batch.num_rows, dtype=np.int64)
            places[order] = np.arange(batch.num_rows)
        best.merge(queries, scores, np.arange(batch.num_rows) if index is None else index, ids, places)


def found_schema(id_type, chunk_id_type):
    return T.StructType([
        T.StructField("query_id", id_type),
        T.StructField("chunk_id", chunk_id_type),
        T.StructField("score", T.DoubleType()),
    ])


def scan_topk(source: DataFrame, rows, id_type, k, score, payload, cut=None) -> DataFrame:
    """One pass over `source` for one block of query rows, ranked per query."""
    return rank_by_score(scan_scores(source, rows, id_type, k, score, payload, cut), k)


def scan_scores(source: DataFrame, rows, id_type, k, score, payload, cut=None) -> DataFrame:
    """The best `k` rows per query and task of one pass over `source` for one block of query rows.

    `score(payload, batch)` yields `(queries, index, scores)` for parts of an
    Arrow batch: query numbers, row numbers (or None for all
    rows), and a score matrix with `-inf` for what cannot match. Filters are
    applied to the scores before any row is dropped. `cut(batch)` yields parts of a
    batch that are scored one after another, where its rows may be large.
    """
    chunk_id_type = source.schema["chunk_id"].dataType
    out = found_schema(id_type, chunk_id_type)
    if not rows:
        return source.sparkSession.createDataFrame([], out)
    filters = Filters.of_rows(rows)
    if filters.active:
        source = source.where(filters.pushed())
    else:
        source = source.drop("members", "ministry")
    ids = [row["query_id"] for row in rows]
    # Plain values only: broadcasts are pickled by reference to their classes.
    sent = source.sparkSession.sparkContext.broadcast((ids, filters.distinct, filters.of_query, payload))
    arrow_id, arrow_chunk_id = to_arrow_type(id_type), to_arrow_type(chunk_id_type)

    def run(batches):
        query_ids, distinct, of_query, data = sent.value
        limits = Filters(distinct, of_query)
        best = BestRows(len(query_ids), k)
        for batch in batches:
            if batch.num_rows:
                for part in cut(batch) if cut else [batch]:
                    fold_batch(best, limits, part, score(data, part))
        yield best.to_batch(query_ids, arrow_id, arrow_chunk_id)

    return source.mapInArrow(run, out)
