"""Benchmark decontamination by spaced-seed hashing.

A document leaks a passage if, laid side by side at some offset, some stretch of
both holds at least `coverage` of the passage's words as equal ones, and `identity`
of the words in the stretch are equal.

A mask marks which words of a window count. Windows of the test passages are
hashed under the masks of their length, and so is every window of every document:
a replaced word leaves the hash of a mask that ignores it unchanged. The masks are
such that every leak by the standard `coverage` and `identity`, or by stricter ones,
has a hit. Where hashes meet, the document and the passage are compared word by word
over the whole overlap, and of all stretches that meet both conditions the one with
the most equal words is taken, of these the shortest and then the first.

The hashed passages are the stated query set. They go to the tasks in blocks of
at most `BLOCK_BYTES` of text, each block with one pass over the documents;
documents are never shuffled, and rows come only from documents with a leak.

Defined results: passages without words, or null, leak nowhere; null or empty
documents leak nothing. Repeated documents and repeated passages each get their
rows. Empty tables give no rows. Other columns stay as they are.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..session import write_and_read
from .words import scramble, slices, words_of

# Which words of a window count, for passages of at least `LONG` words.
MASKS = ("110111100000", "111010000011", "110100011100", "000111011100")
SPAN = 12
LONG = 16
# The same by the number of words of shorter passages.
_SEVEN = ("11111", "101111", "110111", "111011", "111101")
_TWELVE = ("1101111", "11110011", "110011011", "10101111", "11110101")
SHORT_MASKS = {
    1: ("1",), 2: ("11",), 3: ("11",), 4: ("111",), 5: ("111", "1011"), 6: ("1111", "10111", "11011", "11101"),
    7: _SEVEN, 8: _SEVEN, 9: ("111111", "1011111", "1101111", "1110111", "1111011", "1111101"),
    10: ("110111", "11111", "1101011", "1001111"),
    11: ("1011111", "11100111", "1100101011", "11101101", "1101010011", "1111011"),
    12: _TWELVE, 13: _TWELVE, 14: ("1101111", "111010011", "1010011011", "111111"),
    15: ("1101111", "11100010011", "110100111", "111111"),
}
COVERAGE = 0.6
IDENTITY = 0.8
# What a replaced word costs against an equal one where `IDENTITY` of a stretch is equal.
MISMATCH = -4
BLOCK_BYTES = 8 << 20
# Most bits of the table that is asked before the exact search.
FILTER_BITS = 22
# Words that are compared at once.
COMPARED = 1 << 22


def _words(texts):
    """Words without regard to case, in any script."""
    return words_of(pc.utf8_lower(texts))


def masks_of(size):
    """The masks for passages of so many words."""
    return tuple(m.strip("0") for m in MASKS) if size >= LONG else SHORT_MASKS.get(size, ())


def _mix(words, mask):
    """One hash for the words of every window that the mask counts."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for turn, place in enumerate(i for i, c in enumerate(mask) if c == "1"):
        out = (out ^ words[place: place + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
        out ^= out >> np.uint64(31)
    return scramble(out)


class Passages:
    """The hashed windows of a block of test passages."""

    def __init__(self, texts):
        found = _words(pa.array(texts, type=pa.string()))
        self.words = found.hashes
        self.bounds = found.bounds
        self.sizes = np.diff(found.bounds)
        sizes_of = {}
        for size in np.unique(np.minimum(self.sizes, LONG)).tolist():
            for mask in masks_of(size):
                sizes_of.setdefault(mask, []).append(size)
        # Per mask: sorted hashes of windows, the word each begins with, and the table asked before.
        self.tables = []
        for mask, sizes in sizes_of.items():
            fits = np.nonzero(np.isin(np.minimum(self.sizes, LONG), sizes))[0]
            last = self.sizes[fits] - len(mask) + 1
            at = np.arange(last.sum()) + np.repeat(found.bounds[fits] - (np.cumsum(last) - last), last)
            hashes = _mix(self.words, mask)[at]
            order = np.argsort(hashes, kind="stable")
            hashes, at = hashes[order], at[order].astype(np.int32)
            shift = np.uint64(64 - min(FILTER_BITS, len(at).bit_length() + 4))
            table = np.zeros(1 << (64 - int(shift)), dtype=bool)
            table[hashes >> shift] = True
            self.tables.append((mask, hashes, at, shift, table))

    def hits(self, words, bounds):
        """Distinct (text, item, first word) where a passage lies by a window hit; the first may be before the text."""
        out = [np.zeros((3, 0), dtype=np.int64)]
        text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for mask, hashes, starts, shift, table in self.tables:
            mixed = _mix(words, mask)
            at = np.nonzero(table[mixed >> shift])[0]
            at = at[at + len(mask) <= bounds[text_of[at] + 1]]
            low = np.searchsorted(hashes, mixed[at], "left")
            size = np.searchsorted(hashes, mixed[at], "right") - low
            entry = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            at = np.repeat(at, size)
            start = starts[entry].astype(np.int64)
            item = np.searchsorted(self.bounds, start, "right") - 1
            out.append(np.stack([text_of[at], item, at - (start - self.bounds[item])]))
        found = np.concatenate(out, axis=1)
        found = found[:, np.lexsort(found[::-1])]
        fresh = np.ones(found.shape[1], dtype=bool)
        fresh[1:] = (found[:, 1:] != found[:, :-1]).any(axis=0)
        return found[:, fresh]

    def _compared(self, words, bounds, coverage):
        """(text, item, first, equal) of the hits whose overlap holds enough equal words."""
        found = self.hits(words, bounds)
        size = self.sizes[found[1]]
        # Passages of like size are compared at once.
        order = np.argsort(size, kind="stable")
        start = 0
        while start < len(order):
            stop = min(len(order), start + max(1, COMPARED // int(size[order[start]])))
            while stop > start + 1 and (stop - start) * int(size[order[stop - 1]]) > 2 * COMPARED:
                stop = start + (stop - start + 1) // 2
            mine = order[start:stop]
            text, item, first = found[:, mine]
            place = np.arange(int(size[mine].max()))
            at = first[:, None] + place
            inside = (at >= bounds[text][:, None]) & (at < bounds[text + 1][:, None]) & (place < size[mine][:, None])
            mate = np.minimum(self.bounds[item][:, None] + place, len(self.words) - 1)
            equal = inside & (words[np.clip(at, 0, len(words) - 1)] == self.words[mate])
            for i in np.nonzero(equal.sum(axis=1) >= coverage * size[mine] - 1e-9)[0]:
                yield int(text[i]), int(item[i]), int(first[i]), equal[i, : size[mine][i]]
            start = stop

    def leaks(self, words, bounds, coverage, identity):
        """(text, item, start, end, equal, size): the best leak of each item in each text."""
        best = {}
        for text, item, first, equal in self._compared(words, bounds, coverage):
            stretch = best_stretch(equal, coverage, identity)
            if stretch:
                start, end, number = stretch
                low = first - int(bounds[text])
                key, found = (text, item), (number, start - end, -low - start, start + low, end + low)
                best[key] = max(best.get(key, found), found)
        return [(t, i, s, e, n, int(self.sizes[i])) for (t, i), (n, _, _, s, e) in sorted(best.items())]


def best_stretch(equal, coverage, identity):
    """(start, end, equal words) of the stretch that meets both conditions with the most equal words, or None."""
    total = np.r_[0, np.cumsum(equal)]
    # A stretch has enough equal words if this does not fall along it.
    lead = total - identity * np.arange(len(total))
    floor = np.minimum.accumulate(lead)
    # For every end the first start that will do; it has the most equal words.
    start = np.searchsorted(-floor, -(lead + 1e-9), "left")
    number = total - total[np.minimum(start, np.arange(len(total)))]
    most = int(number.max())
    if most == 0 or most < coverage * len(equal) - 1e-9:
        return None
    ends = np.nonzero(number == most)[0]
    # Replaced words at either side don't belong to it.
    spans = []
    for end in ends.tolist():
        places = np.nonzero(equal[start[end]: end])[0]
        spans.append((int(places[-1] - places[0] + 1), int(start[end] + places[0])))
    length, first = min(spans)
    return first, first + length, most


def _blocks(items: DataFrame, text):
    """The passages in blocks of bounded size, as lists of (id, text)."""
    items = items.where(F.col(text).isNotNull())
    total = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # Half full on average, so that a block stays within the bound.
    parts = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    if parts == 1:
        yield [tuple(r) for r in items.collect()]
        return
    numbered = items.withColumn("_block", F.pmod(F.xxhash64(text), F.lit(parts)).cast("int"))
    stored = write_and_read(numbered.repartition("_block"), "passages", partition_by=["_block"])
    for part in range(parts):
        yield [tuple(r) for r in stored.where(F.col("_block") == part).drop("_block").collect()]


def leaks(docs: DataFrame, items: DataFrame, key="doc_id", text="text", item="item_id", coverage=COVERAGE, identity=IDENTITY) -> DataFrame:
    """(key, item, start_word, end_word, equal_words, item_words) of every leak."""
    source = docs.select(F.col(key), F.col(text).alias("_text"))
    item_type = items.schema[item].dataType
    out = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField(item, item_type),
        *(T.StructField(n, T.IntegerType()) for n in ("start_word", "end_word", "equal_words", "item_words"))])
    arrow, arrow_item = to_arrow_schema(out), to_arrow_type(item_type)
    spark, result = docs.sparkSession, None
    for block in _blocks(items.select(item, text), text):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            passages = Passages([t for _, t in sent.value])
            ids = [i for i, _ in sent.value]
            for batch in batches:
                for part in slices(batch, "_text"):
                    found = _words(part.column("_text"))
                    rows = passages.leaks(found.hashes, found.bounds, coverage, identity)
                    if rows:
                        texts, items_, *numbers = (list(c) for c in zip(*rows))
                        yield pa.RecordBatch.from_arrays([
                            part.column(0).take(pa.array(texts)).cast(arrow.field(0).type),
                            pa.array([ids[i] for i in items_], type=arrow_item),
                            *(pa.array(n, type=pa.int32()) for n in numbers),
                        ], schema=arrow)

        found = source.mapInArrow(run, out)
        result = found if result is None else result.unionByName(found)
    return result


def clean_documents(docs: DataFrame, items: DataFrame, text="text", item_text="text", coverage=COVERAGE, identity=IDENTITY) -> DataFrame:
    """The documents that leak no passage, in one pass per block of passages, without a shuffle."""
    schema = docs.schema
    at = docs.columns.index(text)
    spark = docs.sparkSession
    for block in _blocks(items.select(item_text), item_text):
        sent = spark.sparkContext.broadcast([t for (t,) in block])

        def run(batches, sent=sent):
            passages = Passages(sent.value)
            for batch in batches:
                for part in slices(batch, text):
                    found = _words(part.column(at))
                    rows = passages.leaks(found.hashes, found.bounds, coverage, identity)
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[row[0] for row in rows]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
