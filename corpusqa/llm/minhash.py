"""Near duplicates by MinHash of one permutation, with every link confirmed on full sets.

A text is the set of its runs of `shingle` words. One hash of each run gives it a bin
and a value, and a bin keeps its least value. An empty bin takes the value of the
first full bin in an order of its own, the same for all texts (optimal
densification), so texts agree on each bin with the probability of their similarity,
however short they are. `BAND` bins make a band, and texts that agree on a band meet
in its bucket: at a similarity of 0.8, two texts meet nowhere once in twenty million.

Texts with equal sets are one node. In a bucket, all nodes are candidates of its
smallest one, a star, so candidates number at most the members of the buckets.
Candidates are dropped if sizes or bins rule out the similarity; the texts of the
others are brought together, in bounded groups around the centre, and compared as
full sets of 64-bit hashes.

A star says nothing of two members that are no copies of its centre. After the first
components, a bucket is done if its members are in one component. In those left
open, every member that is not with the centre is held against all members, in
blocks of `BLOCK` times `BLOCK` whose bins are compared as arrays. Pairs that bins don't
rule out join their texts to a family; a block sends no more of them than it has
members. Within a family all texts of different components are compared as full sets,
again in blocks, which send on only what joins two components. So every two texts of
a bucket are linked, known to be in one component, or found to be different, and no
step sends pairs that grow with the square of a group.

Bins are taken to rule out the similarity if those that agree are `DEVIATIONS` standard
deviations below what is expected: at 0.8, where 102 of 128 are expected, below 75.
Small sets, whose bins depend on each other, skip that test.

Defined results: null and empty texts and those without words have no run and are
linked with nothing. A text with fewer words than a run is one run. A component is
named by its smallest key, null only where there is no other. Repeated rows are kept,
each with the result of its text. Empty tables give no rows. Other columns don't
matter to `near_duplicates`, and stay as they are in `keep_one`.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import write_and_read
from .components import components
from .words import NO_BLANK, lengths, scramble, slices, words_of

SHINGLE_WORDS = 5
PERCENT = 80
BINS = 128
BAND = 4
DEVIATIONS = 6
# Below this many runs, agreeing bins don't rule anything out.
SMALL_SET = 64
# Members that are compared with one centre, or with one block, by one group; and runs of theirs that a task holds.
BLOCK = 512
BLOCK_RUNS = 1 << 20
# Rows of bins that are handled together.
CHUNK = 1 << 13
PACKED_BYTES = 1 << 20
# The number of a row beside a caller's columns.
ROW = "corpusqa row"

SKETCH = [
    *(T.StructField(name, T.LongType()) for name in ("n", "sum1", "sum2")), T.StructField("bins", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bytes", T.LongType()), T.StructField("packed", T.BinaryType()),
]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
# For each bin the order in which it looks for a full one.
_DONORS = np.argsort(scramble(np.arange(1, BINS * BINS + 1, dtype=np.uint64).reshape(BINS, BINS)), axis=1)


def shingle_sets(array, size):
    """Hashes of the different runs of each text, sorted within it, and the bounds of the texts."""
    found = words_of(array, NO_BLANK)
    words, bounds = found.hashes, found.bounds
    many = np.diff(bounds)
    padded = np.r_[words, np.zeros(size, dtype=np.uint64)]
    run, folds = words, [words]
    for j in range(1, size):
        run = scramble(run * _ODD + padded[j: j + len(words)])
        folds.append(run)
    text = found.text_of()
    full = np.nonzero(np.arange(len(words)) + size <= bounds[1:][text])[0]
    owners, values = [text[full]], [folds[-1][full]]
    for m in range(1, size):
        short = np.nonzero(many == m)[0]
        owners.append(short)
        values.append(scramble(folds[m - 1][bounds[short]] ^ np.uint64(m)))
    owners, values = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (owners[1:] != owners[:-1]) | (values[1:] != values[:-1])
    owners, values = owners[fresh], values[fresh]
    return values, np.searchsorted(owners, np.arange(len(many) + 1))


def bins_of(values, bounds):
    """The densified bins of each set, of shape (sets, BINS); empty sets have empty bins."""
    rows = len(bounds) - 1
    hashed = scramble(values ^ _ODD)
    owners = np.repeat(np.arange(rows), np.diff(bounds))
    own = np.full(rows * BINS, _EMPTY)
    np.minimum.at(own, owners * BINS + (hashed % np.uint64(BINS)).astype(np.int64), hashed >> np.uint64(7))
    own = own.reshape(rows, BINS)
    out = own.copy()
    row, place = np.nonzero((own == _EMPTY) & (np.diff(bounds) > 0)[:, None])
    for step in range(BINS):
        if not len(row):
            break
        got = own[row, _DONORS[place, step]]
        out[row, place] = got
        left = got == _EMPTY
        row, place = row[left], place[left]
    return out


def _band_keys(bins):
    parts = bins.reshape(len(bins), BINS // BAND, BAND)
    key = parts[:, :, 0]
    for i in range(1, BAND):
        key = scramble(key * _ODD + parts[:, :, i])
    return scramble(key + np.arange(BINS // BAND, dtype=np.uint64))


def _sums(values, bounds):
    """Sum of the values of each set."""
    total = np.r_[np.uint64(0), np.cumsum(values, dtype=np.uint64)]
    return total[bounds[1:]] - total[bounds[:-1]]


def _sketched(rows: DataFrame, shingle) -> DataFrame:
    """Of (row, key, text): the size, two checksums and the bins of the set, its bands, and the packed text."""
    out = T.StructType([rows.schema["row"], rows.schema["key"], *SKETCH])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                values, bounds = shingle_sets(part.column("text"), shingle)
                bins = bins_of(values, bounds)
                small = (scramble(bins) >> np.uint64(48)).astype("<u2")
                keys = _band_keys(bins).view(np.int64)
                offsets = np.arange(0, keys.size + 1, BINS // BAND, dtype=np.int32)
                plain = [t.as_py() or b"" for t in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("key"), pa.array(np.diff(bounds)),
                    pa.array(_sums(scramble(values), bounds).view(np.int64)), pa.array(_sums(scramble(values * _ODD), bounds).view(np.int64)),
                    pa.array([r.tobytes() for r in small], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))).cast(arrow.field("bands").type),
                    pa.array([len(t) for t in plain], pa.int64()),
                    pa.array([pa.compress(t, "zstd", asbytes=True) for t in plain], pa.binary()),
                ], schema=arrow)

    return rows.mapInArrow(run, out)


def _unpacked(part):
    return pa.array([
        pa.decompress(p.as_py(), n, "zstd", asbytes=True) for p, n in zip(part.column("packed"), part.column("bytes").to_pylist())
    ], pa.large_binary()).cast(pa.large_string())


def _agreeing(left, right):
    """How many bins agree, row by row or all with all."""
    return (left == right).sum(axis=-1)


def least_bins(percent):
    """How many bins agree at least at a similarity of `percent`, with near certainty."""
    share = percent / 100
    return int(np.floor(BINS * share - DEVIATIONS * np.sqrt(BINS * share * (1 - share))))


def _may_link(n_a, n_b, agree, percent):
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & ((agree >= least_bins(percent)) | (np.minimum(n_a, n_b) < SMALL_SET))


def _bins(column):
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), BINS)


def _likely(edges: DataFrame, nodes: DataFrame, percent) -> DataFrame:
    """The edges (a, b) that sizes and bins don't rule out."""
    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}")) for x in "ab"]
    near = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")

    def run(batches):
        for batch in batches:
            agree = _agreeing(_bins(batch.column("bins_a")), _bins(batch.column("bins_b")))
            sizes = [batch.column(f"n_{x}").to_numpy() for x in "ab"]
            yield batch.select(["a", "b"]).filter(pa.array(_may_link(*sizes, agree, percent)))

    return edges.join(sides[0], "a").join(sides[1], "b").where(near).mapInArrow(run, "a long, b long")


def _confirmed(edges: DataFrame, texts: DataFrame, shingle, percent) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough.

    Edges are gathered around `a`, at most about `BLOCK` in a group; the text of `a`
    goes to each of its groups.
    """
    groups = edges.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("groups"))
    centres = groups.select(F.col("a").alias("row"), "a", F.explode(F.sequence(F.lit(0), F.col("groups").cast("int") - 1)).alias("group"), F.lit(0).alias("role"))
    members = edges.join(groups, "a").select(
        F.col("b").alias("row"), "a", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("group"), F.lit(1).alias("role"))
    brought = texts.join(centres.unionByName(members), "row").repartition("a", "group").sortWithinPartitions("a", "group", "role")

    def run(batches):
        at, centre = None, None
        for batch in batches:
            for part in slices(batch, "packed", PACKED_BYTES):
                values, bounds = shingle_sets(_unpacked(part), shingle)
                a, group, role, row = (part.column(c).to_numpy() for c in ("a", "group", "role", "row"))
                change = np.r_[True, (a[1:] != a[:-1]) | (group[1:] != group[:-1])]
                heads = np.r_[np.nonzero(change)[0], len(a)]
                links = []
                for first, last in zip(heads[:-1], heads[1:]):
                    if at != (a[first], group[first]):
                        # The centre stands first in its group.
                        at, centre = (a[first], group[first]), values[bounds[first]: bounds[first + 1]]
                    members = first + np.nonzero(role[first:last])[0]
                    if not len(members):
                        continue
                    mine = values[bounds[members[0]]: bounds[last]]
                    place = np.minimum(np.searchsorted(centre, mine), len(centre) - 1)
                    total = np.r_[0, np.cumsum(centre[place] == mine)]
                    ends = bounds[members[0]: last + 1] - bounds[members[0]]
                    both, size = total[ends[1:]] - total[ends[:-1]], np.diff(ends)
                    links.append(members[100 * both >= percent * (size + len(centre) - both)])
                found = np.concatenate(links) if links else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(row[found])], names=["a", "b"])

    return brought.select("a", "group", "role", "row", "bytes", "packed").mapInArrow(run, "a long, b long")


def _family_ties(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, percent) -> DataFrame:
    """Ties (a, b) of buckets whose members are in several components: likely pairs, no more than join the members they tie.

    Members in the centre's component are known to be in one; every other is held
    against all members but the centre, block by block.
    """
    label = labels.select("node", "root")
    centre = labels.select(F.col("node").alias("centre"), F.col("root").alias("centre_root"))
    known = buckets.join(label, "node", "left").join(centre, "centre", "left").select(
        "key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("centre_root", "centre").alias("centre_root"),
        (F.col("node") == F.col("centre")).alias("is_centre"))
    known = write_and_read(known.withColumn("stray", F.col("root") != F.col("centre_root")), "labelled")
    counts = known.groupBy("key").agg(F.count_if("stray").alias("strays"), F.count("*").alias("members")).where("strays > 0 and members > 2")
    counts = counts.select("key", F.ceil(F.col("strays") / BLOCK).cast("int").alias("s"), F.ceil((F.col("members") - 1) / BLOCK).cast("int").alias("m"))
    # The centre has met all members already.
    left = known.where(~F.col("is_centre")).join(counts, "key").join(nodes.select("node", "n", "bins"), "node")
    block = lambda many: F.pmod(F.xxhash64("node", F.lit(7)), many).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    strays = left.where("stray").select("key", block(F.col("s")).alias("i"), every("m").alias("j"), F.lit(0).alias("role"), "node", "root", "n", "bins")
    members = left.select("key", every("s").alias("i"), block(F.col("m")).alias("j"), F.lit(1).alias("role"), "node", "root", "n", "bins")
    dealt = strays.unionByName(members).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")

    def run(batches):
        for part, heads in _whole_groups(batches, ("key", "i", "j")):
            role, node, root, n = (part.column(c).to_numpy() for c in ("role", "node", "root", "n"))
            bins, out = _bins(part.column("bins")), []
            for first, last in zip(heads[:-1], heads[1:]):
                member = first + np.nonzero(role[first:last])[0]
                joined = np.arange(last - first)
                for q in first + np.nonzero(role[first:last] == 0)[0]:
                    near = _may_link(n[q], n[member], _agreeing(bins[q], bins[member]), percent) & (root[member] != root[q])
                    out += _join(joined, q - first, member[near] - first, node[first:last])
            yield _links(out)

    return dealt.mapInArrow(run, "a long, b long")


def _whole_groups(batches, names, column=None, most=PACKED_BYTES):
    """Tables of whole groups with the bounds of each group; `most` rows, or bytes of a column, or one group."""

    def cut(held):
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(n).to_numpy() for n in names]
        change = np.any([k[1:] != k[:-1] for k in keys], axis=0) if len(table) > 1 else np.zeros(0, dtype=bool)
        return table, np.r_[0, np.nonzero(change)[0] + 1, len(table)]

    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, most) if column else [batch]:
            if part.num_rows == 0:
                continue
            held.append(part)
            size += lengths(part.column(column)).sum() if column else part.num_rows
            if size >= (most if column else CHUNK):
                table, heads = cut(held)
                # The last group may go on.
                if len(heads) > 2:
                    yield table.slice(0, heads[-2]), heads[:-1]
                    held, size = table.slice(heads[-2]).to_batches(), 0
    if held:
        yield cut(held)


def _join(joined, one, others, node):
    """Join the groups of `one` and `others`, places in `joined`; the links that did it."""
    out = []
    for other in others[joined[others] != joined[one]]:
        if joined[other] != joined[one]:
            joined[joined == joined[other]] = joined[one]
            out.append((node[one], node[other]))
    return out


def _links(pairs):
    found = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _family_links(families: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, shingle, percent) -> DataFrame:
    """Links (a, b) that join different components within families, found on full sets."""
    member = families.select("node", F.col("root").alias("family")).join(labels, "node", "left")
    member = member.select("node", "family", F.coalesce("root", "node").alias("root")).join(nodes.select("node", "n", "bins"), "node")
    member = write_and_read(member, "families")
    blocks = member.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_RUNS)).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = member.join(blocks, "family").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(9)), "blocks").cast("int")).withColumn("other", other)
    dealt = dealt.select(
        "family", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", F.col("node").alias("row"), "root", "n", "bins")
    dealt = dealt.join(texts, "row").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "row")

    def run(batches):
        for part, heads in _whole_groups(batches, ("family", "i", "j"), "packed"):
            row, root, n, i, j, mine = (part.column(c).to_numpy() for c in ("row", "root", "n", "i", "j", "mine"))
            bins = _bins(part.column("bins"))
            values, bounds = shingle_sets(_unpacked(part), shingle)
            out = []
            for first, last in zip(heads[:-1], heads[1:]):
                joined = np.unique(root[first:last], return_inverse=True)[1]
                ids = np.unique(values[bounds[first]: bounds[last]], return_inverse=True)[1]
                ends = bounds[first: last + 1] - bounds[first]
                size, mark = np.diff(ends), np.zeros(len(ids), dtype=bool)
                # Two blocks are held against each other, one against itself.
                left = np.arange(last - first) if i[first] == j[first] else np.nonzero(mine[first:last] == i[first])[0]
                right = np.arange(last - first) if i[first] == j[first] else np.nonzero(mine[first:last] == j[first])[0]
                for q in left:
                    near = right[(joined[right] != joined[q]) & _may_link(n[first + q], n[first + right], _agreeing(bins[first + q], bins[first + right]), percent)]
                    if not len(near):
                        continue
                    mark[ids[ends[q]: ends[q + 1]]] = True
                    total = np.r_[0, np.cumsum(mark[ids])]
                    mark[ids[ends[q]: ends[q + 1]]] = False
                    both = (total[ends[1:]] - total[ends[:-1]])[near]
                    near = near[100 * both >= percent * (size[near] + size[q] - both)]
                    out += _join(joined, q, near, row[first:last])
            yield _links(out)

    return dealt.select("family", "i", "j", "mine", "row", "root", "n", "bins", "bytes", "packed").mapInArrow(run, "a long, b long")


def _grouped(rows: DataFrame, shingle, percent) -> DataFrame:
    """Of a table (row, key, text) the stored (row, key, n, root); no root where there is no run."""
    sketches = write_and_read(_sketched(rows, shingle), "sketches")
    each = sketches.where("n > 0").groupBy("sum1", "sum2", "n").agg(
        F.min("row").alias("node"), F.first("bins").alias("bins"), F.first("bands").alias("bands"))
    nodes = write_and_read(each, "sets")
    bands = nodes.select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1")
    buckets = write_and_read(bands.join(shared.drop("members"), "key"), "buckets")
    # The texts of all that share a bucket, once.
    texts = sketches.select("row", "bytes", "packed").join(buckets.select(F.col("node").alias("row")).distinct(), "row", "left_semi")
    texts = write_and_read(texts, "texts")
    stars = buckets.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    stars = write_and_read(_likely(stars, nodes, percent), "stars")
    links = write_and_read(_confirmed(stars, texts, shingle, percent), "links")
    labels = components(links)
    families = components(_family_ties(buckets, labels, nodes, percent))
    rest = write_and_read(_family_links(families, labels, nodes, texts, shingle, percent), "links")
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))
    named = nodes.select("sum1", "sum2", "n", "node").join(labels, "node", "left")
    named = named.select("sum1", "sum2", "n", F.coalesce("root", "node").alias("root"))
    # Copies may be a third of all rows: joined by shuffle on both sides, a hot set is split.
    return write_and_read(
        sketches.select("row", "key", "n", "sum1", "sum2").join(named, ["sum1", "sum2", "n"], "left").select("row", "key", "n", "root"), "members")


def near_duplicates(docs: DataFrame, key="doc_id", text="text", shingle=SHINGLE_WORDS, percent=PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row, under the name of the key."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    member = _grouped(rows, shingle, percent)
    least = member.where("root is not null").groupBy("root").agg(F.min("key").alias("least"))
    named = member.join(write_and_read(least, "components"), "root", "left")
    return named.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, key="doc_id", text="text", shingle=SHINGLE_WORDS, percent=PERCENT) -> DataFrame:
    """The documents with one left of each component: its smallest key, then the row read first."""
    stored = write_and_read(docs.withColumn(ROW, F.monotonically_increasing_id()), "documents")
    rows = stored.select(F.col(ROW).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    member = _grouped(rows, shingle, percent)
    best = member.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("best"))
    gone = member.join(best, "root").where("row <> best.row").select(F.col("row").alias(ROW))
    return stored.join(write_and_read(gone, "gone"), ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    """One row per document: the size of its set of runs of four words, its component, and whether it stays."""
    found = near_duplicates(docs, shingle=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
