"""Near duplicates by SimHash, with a Gray-order hierarchical index.

Every text becomes a 64-bit fingerprint. Fingerprints that differ in few bits are
linked, and linked fingerprints form components, down to the last chain.

Equal fingerprints are merged first, so a group of copies is one fingerprint.
Two fingerprints that differ in at most `d` bits agree on one of `d + 1` blocks
of bits, so each fingerprint goes to one bucket per block. A bucket above
`BUCKET_ROWS` fingerprints is cut further: its members agree on the block, so
they agree on one of `d + 1` blocks of the bits that are left. Nothing is lost,
and a bucket that runs out of bits is small by itself.

Within a task the fingerprints of each bucket are sorted by Gray rank, so that
neighbours share bits. Runs of them form nodes, runs of nodes form nodes above:
a node keeps the bits that all below it share and that no node above keeps. A
search carries the differences counted so far from a node to its children and
drops a whole group as soon as they exceed `d`. All searches of a slice move down
together as arrays. Links of a bucket are joined on the spot and sent as one row
per fingerprint, never as all pairs; the components of the whole table follow from
those links.

Defined results: null and empty texts, and texts without words, have fingerprint
zero, which links like any other. A component is named by its smallest key; null
keys count only where there is no other. Repeated rows are kept, each with the
result of its text. An empty table gives no rows. Other columns stay as they are.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import write_and_read
from .components import components
from .words import slices

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
BUCKET_ROWS = 50_000
FANOUT = 8
# Columns beside a caller's.
ROW, PRINT = "corpusqa row", "corpusqa print"
# Bytes of text that are worked on together: other tasks of an executor do so at the same time.
TEXT_BYTES = 1 << 20
# Shingles, and searches, that are handled together.
CHUNK = 1 << 14
# Fingerprints that a task holds before it searches their buckets, unless one bucket has more.
HELD = 1 << 17
# Nodes that searches may visit at one depth together; beyond it fewer go down at a time.
VISITS = 1 << 18


def _fingerprint(text, size):
    """SimHash of one text in UTF-8: the majority of each bit over its shingles' XXH64."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and the ASCII blanks
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    starts, ends = starts[: len(words) - size + 1], ends[size - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at: at + CHUNK].tolist(), ends[at: at + CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(df: DataFrame, text="text", shingle=SHINGLE_WORDS, into="fingerprint", drop_text=False) -> DataFrame:
    """Add the 64 bits as a signed long. `drop_text` leaves the text out of the result."""
    fields = [f for f in df.schema if f.name != into and not (drop_text and f.name == text)]
    out = T.StructType([*fields, T.StructField(into, T.LongType())])
    arrow = to_arrow_schema(out)
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                texts = part.column(text).cast(pa.binary())
                values = np.array([_fingerprint(t.as_py() or b"", shingle) for t in texts], dtype=np.uint64)
                columns = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [*(c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)), pa.array(values.view(np.int64))],
                    schema=arrow)

    return df.mapInArrow(run, out)


def as_hex(fingerprint):
    """A signed long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def gray_rank(prints):
    """Position of each 64-bit pattern in the Gray sequence."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over fingerprints sorted by bucket and Gray rank.

    `levels[0]` are the fingerprints, each further level groups up to `FANOUT`
    nodes of the same bucket; the last has one node per bucket. `own` are the bits
    a node shares below and does not leave to a node above, `pattern` their values.
    """

    def __init__(self, prints, buckets):
        self.levels = []
        ones, zeros, run = prints, ~prints, buckets
        child_of = None
        while True:
            self.levels.append({"ones": ones, "zeros": zeros, "first": child_of, "run": run})
            head = np.r_[True, run[1:] != run[:-1]]
            if head.all():
                break
            at = np.nonzero(head)[0]
            rank = np.arange(len(run)) - np.repeat(at, np.diff(np.r_[at, len(run)]))
            child_of = np.nonzero(rank % FANOUT == 0)[0]
            ones, zeros = np.bitwise_and.reduceat(ones, child_of), np.bitwise_and.reduceat(zeros, child_of)
            run = run[child_of]
        above = None
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            shared = level["ones"] | level["zeros"]
            if above is not None:
                first = self.levels[depth + 1]["first"]
                sizes = np.diff(np.r_[first, len(shared)])
                level["own"] = shared & ~np.repeat(above, sizes)
            else:
                level["own"] = shared
            above = shared
        for level in self.levels:
            level["pattern"] = level["ones"] & level["own"]

    def search(self, prints, nodes, most):
        """(query, fingerprint number) of all within `most` bits, from given top nodes.

        None where more nodes would be visited together than there is room for.
        """
        query = np.arange(len(prints))
        far = np.zeros(len(prints), dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            if depth < len(self.levels) - 1:
                first = self.levels[depth + 1]["first"]
                size = np.diff(np.r_[first, len(level["own"])])[nodes]
                if size.sum() > VISITS and len(prints) > 1:
                    return None
                query, far = np.repeat(query, size), np.repeat(far, size)
                nodes = np.repeat(first[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            far = far + np.bitwise_count((prints[query] ^ level["pattern"][nodes]) & level["own"][nodes])
            near = far <= most
            query, nodes, far = query[near], nodes[near], far[near]
        return query, nodes


def _roots(count, left, right):
    """Smallest member of each item's component, by hooking and halving on arrays."""
    root = np.arange(count)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low < high
        if not apart.any():
            break
        left, right = left[apart], right[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            shorter = root[root]
            if (shorter == root).all():
                break
            root = shorter
    return root


def _bucket_links(most):
    """Links of the buckets of one task: (fingerprint, smallest of its group there)."""

    def links(buckets, prints):
        order = np.lexsort((gray_rank(prints), buckets))
        buckets, prints = buckets[order], prints[order]
        index = GrayIndex(prints, buckets)
        top = np.cumsum(np.r_[False, buckets[1:] != buckets[:-1]])
        # One search per member; as many move down together as there is room for.
        everyone = np.arange(len(prints))
        linked, at, width = everyone, 0, CHUNK
        found_by, found, waiting = [everyone], [linked], 0
        while at < len(prints):
            stop = min(at + width, len(prints))
            pairs = index.search(prints[at:stop], top[at:stop], most)
            if pairs is None:
                width = max(1, width // 4)
                continue
            later = pairs[1] > pairs[0] + at
            found_by.append(pairs[0][later] + at)
            found.append(pairs[1][later])
            waiting += len(found[-1])
            at, width = stop, min(CHUNK, 2 * width)
            if waiting >= VISITS or at == len(prints):
                linked = _roots(len(prints), np.concatenate(found_by), np.concatenate(found))
                found_by, found, waiting = [everyone], [linked], 0
        keep = linked != np.arange(len(prints))
        return prints[keep], prints[linked[keep]]

    def run(batches):
        held_b, held_p, rows = [], [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held_b.append(batch.column("bucket").to_numpy())
            held_p.append(batch.column("fingerprint").to_numpy().view(np.uint64))
            rows += batch.num_rows
            if rows < HELD:
                continue
            # The last bucket may go on in the next batch.
            b, p = np.concatenate(held_b), np.concatenate(held_p)
            cut = int(np.nonzero(np.r_[True, b[1:] != b[:-1]])[0][-1])
            held_b, held_p, rows = [b[cut:]], [p[cut:]], len(b) - cut
            if cut:
                yield to_batch(*links(b[:cut], p[:cut]))
        if rows:
            yield to_batch(*links(np.concatenate(held_b), np.concatenate(held_p)))

    def to_batch(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def _blocks(bits, parts):
    """Cut a list of bit numbers into `parts` blocks of nearly equal size."""
    return [bits[i * len(bits) // parts: (i + 1) * len(bits) // parts] for i in range(parts)]


def _mask(bits):
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def buckets_of(prints: DataFrame, most=MAX_BITS, bucket_rows=BUCKET_ROWS) -> DataFrame:
    """(bucket, fingerprint) so that all within `most` bits meet in a bucket of bounded size."""

    def cut(rows, free, path):
        """Rows with a column `bucket` to be refined by blocks of the free bits."""
        blocks = [b for b in _blocks(free, most + 1) if b]
        options = F.array(*[
            F.struct(F.lit(i).alias("block"), F.xxhash64("bucket", F.lit(path), F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(_mask(b)))).alias("bucket"))
            for i, b in enumerate(blocks)
        ])
        return blocks, rows.select("fingerprint", F.explode(options).alias("at")).select("fingerprint", "at.block", "at.bucket")

    finished = []
    waiting = [(prints.select(F.lit(0).cast("long").alias("bucket"), "fingerprint"), list(range(64)), "")]
    while waiting:
        rows, free, path = waiting.pop()
        blocks, dealt = cut(rows, free, path)
        full = dealt.groupBy("block", "bucket").count().where(F.col("count") > bucket_rows).drop("count")
        if len(free) <= 20:  # at most 2^20 fingerprints agree on all other bits
            finished.append(dealt.select("bucket", "fingerprint"))
            continue
        full = write_and_read(full, "buckets")
        crowded = {row[0] for row in full.select("block").distinct().collect()}
        if not crowded:
            finished.append(dealt.select("bucket", "fingerprint"))
            continue
        finished.append(dealt.join(full, ["block", "bucket"], "left_anti").select("bucket", "fingerprint"))
        for i in sorted(crowded):
            rest = [b for b in free if b not in blocks[i]]
            hot = dealt.where(F.col("block") == i).join(full, ["block", "bucket"], "left_semi")
            waiting.append((hot.select("bucket", "fingerprint"), rest, f"{path}/{i}"))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def bucket_links(prints: DataFrame, most=MAX_BITS, bucket_rows=BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints, a spanning set of each bucket's."""
    dealt = buckets_of(prints, most, bucket_rows).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_bucket_links(most), "a long, b long")


def near_duplicates(prints: DataFrame, key="doc_id", most=MAX_BITS, bucket_rows=BUCKET_ROWS) -> DataFrame:
    """Add `component_id` to a stored table of keys and fingerprints."""
    each = prints.groupBy("fingerprint").agg(F.min(key).alias("smallest"))
    each = write_and_read(each, "prints")
    roots = components(bucket_links(each.select("fingerprint"), most, bucket_rows))
    member = each.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    member = write_and_read(member.withColumn("root", F.coalesce("root", "fingerprint")), "members")
    least = write_and_read(member.groupBy("root").agg(F.min("smallest").alias("component_id")), "components")
    named = write_and_read(member.select("fingerprint", "root").join(least, "root").drop("root"), "named")
    return prints.join(named, "fingerprint")


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprint in hex and component."""
    prints = write_and_read(with_fingerprint(docs.select("doc_id", "text"), drop_text=True), "fingerprints")
    return near_duplicates(prints).select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle=SHINGLE_WORDS, most=MAX_BITS) -> DataFrame:
    """The documents with one left of each component: its smallest doc_id, then the row read first."""
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    stored = write_and_read(with_fingerprint(numbered, shingle=shingle, into=PRINT), "fingerprints")
    at = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    narrow = stored.select(at.alias("at"), F.col(PRINT).alias("fingerprint"))
    found = near_duplicates(narrow, "at", most)
    kept = write_and_read(found.where(F.col("at") == F.col("component_id")).select(F.col(f"at.`{ROW}`").alias(ROW)), "kept")
    # Kept rows grow with the table: the join is by shuffle at every size, whatever a small table would allow.
    return stored.join(kept.hint("merge"), ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
