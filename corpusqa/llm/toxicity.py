"""Toxicity by class-conditional Kneser-Ney language models.

One model is fitted to toxic texts and one to ordinary ones. Both are bigram
models with absolute discounts: what a class has not seen after a word falls back
to the word's own share in the class, and from there to shared backoff counts,
the number of different words before it in the whole corpus, as a share of all
such pairs, in which words that no model knows are one word. The difference of
the two log-likelihoods, per word, is averaged over the whole text, and, as far as its counts
can't be chance, over the window of it that is most toxic, and over its most toxic single word, so that a few words in
a long text are not diluted; a logistic curve makes the three averages a score.

An expression, a word or a pair of words, counts once per document and no more
often than there are different words before it, or after it where those are more,
so that repeated lines and copies weigh no more than one. Both models keep every
word and every pair that labelled texts of either class hold, also those that one text holds once.

The words of labelled texts are numbered; their hashes and a few numbers for each are
sent to the driver and to the tasks. Pairs are never sent anywhere whole: they are a stored table,
counted, weighed and looked up in parts by their code. To be scored, texts are dealt into
chunks by a hash of their row; a chunk asks each part once for the different pairs it holds, and gets their
counts back. Rows that are equal in every column are in one chunk.

Different words beside an expression are counted exactly, but for the hashes of 39 bits that name words no model knows. Tasks
send sorted codes of (expression, word beside), whose differences compress to a
few bytes each, in one row per partition; each partition merges its codes and counts them. The start of a text
counts as a word.

Classes are learned from every labelled row outside the held-out fold. The shared
counts are gathered from every document. The curve is fitted, by sums over a stored
table, to all these rows, each scored by models without its own counts.

Defined results: null and empty texts, and texts without words, have averages of
zero. Without toxic and ordinary rows to learn from every score is 0. Of several
labels of one key the largest counts; null keys and labels teach nothing. Repeated
rows each get their score. Empty tables give no rows. Other columns are kept by
`score_documents` and `drop_toxic`, except for those named like their results.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import broadcast_within, write_and_read
from .labels import held_out, teaching_labels
from .words import scramble, slices, words_of

# Rows of one of the folds are never learned from.
FOLDS, HELD_OUT = 3, 1
# Above this many labels they meet the documents by shuffle.
MAX_BROADCAST_LABELS = 1_000_000
# Different codes that a task holds before it sends them on.
HELD = 1 << 21
# Bytes of labelled text whose pairs are one part, and of text that is scored as one chunk.
PART_BYTES = CHUNK_BYTES = 16 << 20
# Bits of the number of a word in a pair, and of what stands for a group of texts above a pair.
WORD_BITS, GROUP_AT = 31, 62
# The side of a word beside an expression, above its name.
AFTER = 41
# Bytes of text that are worked on together: arrays over their words are many times as large.
TEXT_BYTES = 1 << 20
# Bits of a code that tell the word beside an expression.
BESIDE = 40
WINDOW = 12
# Least difference that one word may count in a window: ordinary words don't pay for toxic ones beside them.
FLOOR = -1.0
COUNTS, TEXTS = [f"n{i}" for i in range(4)], [f"texts{i}" for i in range(4)]
LOOKUP = "part int, chunk int, codes binary, n binary"
# How much a toxic row counts in the fit of the curve, against an ordinary one.
TOXIC_WEIGHT = 4.0
SHORTEST = 8
# The ratio of likelihoods, as twice its logarithm, at which a difference of the classes counts half.
SURE = 25.0
THRESHOLD = 0.7
AVERAGES = ["mean", "window", "word"]
# Columns beside a caller's.
SCORE = "corpusqa toxicity"
CHUNK = "corpusqa chunk"


def labelled_rows(docs: DataFrame, labels: DataFrame, label="toxic", key="doc_id", text="text") -> DataFrame:
    """(text, label, fold) of the labelled rows of each class, stored."""
    chosen = teaching_labels(labels, label, key, FOLDS, HELD_OUT)
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(31)), F.lit(2)).cast("int"))
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(broadcast_within(chosen, MAX_BROADCAST_LABELS), key)
    return write_and_read(rows.select("text", "label", "fold"), "labelled")


def _read(array):
    """Word hashes of a text column without regard to case, and for each word its text."""
    found = words_of(pc.utf8_lower(array))
    return found.hashes, found.text_of(), found.bounds


def _before(words, texts, step=1):
    """The word `step` places before each word, and 0 at the start of a text."""
    out = np.zeros(len(words), dtype=np.uint64)
    same = texts[step:] == texts[:-step]
    out[step:][same] = words[:-step][same]
    return out


def _once(texts, values):
    """Each value once per text."""
    order = np.lexsort((values, texts))
    texts, values = texts[order], values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    return values[fresh]


def _after(words, texts, step=1):
    """The word `step` places after each word, and 0 at the end of a text."""
    out = np.zeros(len(words), dtype=np.uint64)
    same = texts[step:] == texts[:-step]
    out[:-step][same] = words[step:][same]
    return out


def _distinct(codes):
    """Sorted different codes. Sorting is many times faster here than `np.unique`."""
    codes = np.sort(codes)
    fresh = np.ones(len(codes), dtype=bool)
    fresh[1:] = codes[1:] != codes[:-1]
    return codes[fresh]


def _names(words, slots):
    """Short names of words for codes: the number of a known word, or a hash with the highest bit set."""
    unknown = (scramble(words) >> np.uint64(66 - BESIDE)) | np.uint64(1 << (BESIDE - 1))
    return np.where(slots >= 0, slots.astype(np.uint64), unknown)


def _codes(slots, names):
    """Numbered expressions with the word beside them, in 64 bits."""
    return (slots.astype(np.uint64) << np.uint64(BESIDE)) | names


def _pack(codes, parts, by_slot):
    """Rows (part, codes): the differences of sorted codes of each part, byte by byte of equal rank, so that they compress.

    The part is chosen by the expression, or by the word beside it, which then leaves its remainder out.
    """
    name = codes & np.uint64((1 << BESIDE) - 1)
    part = ((codes >> np.uint64(BESIDE) if by_slot else name) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    codes = codes if by_slot else (codes ^ name) | (name // np.uint64(parts))
    codes, bounds = codes[order], np.searchsorted(part[order], np.arange(parts + 1))
    numbers, packed = [], []
    for i in np.nonzero(np.diff(bounds))[0]:
        steps = np.diff(codes[bounds[i]: bounds[i + 1]], prepend=np.uint64(0))
        numbers.append(int(i))
        packed.append(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], names=["part", "codes"])


def _unpack(packed):
    steps = np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64)


class _Held:
    """Different codes of a task, sent on when there are many."""

    def __init__(self, parts, by_slot):
        self.parts, self.by_slot = parts, by_slot
        self.codes, self.new, self.size = np.zeros(0, dtype=np.uint64), [], 0

    def add(self, codes):
        self.new.append(codes)
        self.size += len(codes)
        if self.size >= HELD:
            self.merge()
            if len(self.codes) >= HELD:
                yield self.sent()

    def merge(self):
        self.codes, self.new, self.size = _distinct(np.concatenate([self.codes, *self.new])), [], 0

    def sent(self):
        self.merge()
        out, self.codes = _pack(self.codes, self.parts, self.by_slot), np.zeros(0, dtype=np.uint64)
        return out


def _beside_counts(packed: DataFrame, parts, size):
    """How many different codes each of `size` numbered expressions has, as an array."""

    def run(batches):
        held, new, waiting, at = np.zeros(0, dtype=np.uint64), [], 0, None
        for batch in batches:
            for part, codes in zip(batch.column("part").to_pylist(), batch.column("codes")):
                if part != at:
                    yield counted(_distinct(np.concatenate([held, *new])))
                    held, new, waiting, at = held[:0], [], 0, part
                new.append(_unpack(codes.as_py()))
                waiting += len(new[-1])
                if waiting >= max(HELD, len(held)):
                    held, new, waiting = _distinct(np.concatenate([held, *new])), [], 0
        yield counted(_distinct(np.concatenate([held, *new])))

    def counted(codes):
        slot = codes >> np.uint64(BESIDE)
        first = np.nonzero(np.r_[True, slot[1:] != slot[:-1]][: len(slot)])[0]
        return pa.RecordBatch.from_arrays(
            [pa.array(slot[first].astype(np.int64)), pa.array(np.diff(np.r_[first, len(slot)]))], names=["slot", "n"])

    # Codes of one part stand together in one partition.
    sums = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "slot long, n long")
    found = sums.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def _parts(df: DataFrame):
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _vocabulary(rows: DataFrame):
    """Sorted hashes of all words of the labelled texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, max_bytes=TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(_distinct(_read(part.column("text"))[0]).view(np.int64))], names=["value"])

    found = rows.select("text").mapInArrow(run, "value long").distinct().toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _slots(known, values):
    """Places of hashes among sorted ones; -1 where they are not known."""
    if len(known) == 0:
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _pair_codes(slots, texts):
    """Where the second words of pairs of known words stand, and the codes of the pairs."""
    at = np.nonzero((texts[1:] == texts[:-1]) & (slots[1:] >= 0) & (slots[:-1] >= 0))[0] + 1
    return at, (slots[at - 1].astype(np.uint64) << np.uint64(WORD_BITS)) | slots[at].astype(np.uint64)


def _occurrences(found, texts, slots, pairs):
    """Text and code of each known word, or pair of known words, and the names of the words before and after it."""
    at, codes = _pair_codes(slots, texts) if pairs else (np.nonzero(slots >= 0)[0], slots[slots >= 0].astype(np.uint64))
    names = _names(found, slots) + np.uint64(1)
    return texts[at], codes, _before(names, texts, 1 + pairs)[at], _after(names, texts)[at]


def _parts_of_codes(codes, parts):
    return (scramble(codes) % np.uint64(parts)).astype(np.int64)


def _planes(values, n):
    """The `n` low bytes of numbers, byte by byte of equal rank, so that they compress."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _from_planes(packed, n):
    out = np.zeros((len(packed) // n, 8), dtype=np.uint8)
    out[:, :n] = np.frombuffer(packed, dtype=np.uint8).reshape(n, -1).T
    return out.reshape(-1).view(np.uint64)


def _steps(codes):
    return _planes(np.diff(codes, prepend=np.uint64(0)), 8)


def _starts(values):
    """Where runs of equal sorted values start."""
    return np.nonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])[0]


def _distinct_rows(keys, sides):
    """Each (key, side) once, sorted."""
    order = np.lexsort((sides, keys))
    keys, sides = keys[order], sides[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])
    return keys[fresh], sides[fresh]


def _tallied(keys, n):
    """Sorted different keys and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    first = _starts(keys[order])
    return keys[order][first], np.add.reduceat(n[order], first) if len(first) else n


def _counted(rows: DataFrame, sent, pairs, parts) -> DataFrame:
    """(code, n0 to n3, texts0 to texts3): how often each known word, or pair, counts in each fold and class, and how many texts hold it.

    A task sends, for each part, what it holds of the part: the codes with the
    names beside them, and the codes with their texts.
    """
    none = np.zeros(0, dtype=np.uint64)
    mask = np.uint64((1 << GROUP_AT) - 1)

    def sent_on(keys, sides, texts):
        keys, sides = _distinct_rows(np.concatenate(keys), np.concatenate(sides))
        texts, n = _tallied(np.concatenate(texts), np.ones(sum(map(len, texts)), dtype=np.uint64))
        columns = [[], [], [], [], []]
        part, of_text = _parts_of_codes(keys & mask, parts), _parts_of_codes(texts & mask, parts)
        order, by_text = np.argsort(part, kind="stable"), np.argsort(of_text, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        ends = np.searchsorted(of_text[by_text], np.arange(parts + 1))
        for i in np.nonzero(np.diff(bounds))[0]:
            mine, held = order[bounds[i]: bounds[i + 1]], by_text[ends[i]: ends[i + 1]]
            row = (int(i), _steps(keys[mine]), _planes(sides[mine], 6), _steps(texts[held]), _planes(n[held], 4))
            for column, value in zip(columns, row):
                column.append(value)
        types = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "keys", "sides", "texts", "n"])

    def send(batches):
        keys, sides, texts, size = [none], [none], [none], 0
        for batch in batches:
            for part in slices(batch, max_bytes=TEXT_BYTES):
                found, owner, _ = _read(part.column("text"))
                group = (part.column("fold").to_numpy() * 2 + part.column("label").to_numpy()).astype(np.uint64) << np.uint64(GROUP_AT)
                owner, codes, before, after = _occurrences(found, owner, _slots(sent.value[0], found), pairs)
                codes = codes | group[owner]
                texts.append(_once(owner, codes))
                codes, beside = _distinct_rows(np.r_[codes, codes], np.r_[before, after | np.uint64(1 << AFTER)])
                keys.append(codes)
                sides.append(beside)
                size += len(codes)
                if size >= HELD:
                    yield sent_on(keys, sides, texts)
                    keys, sides, texts, size = [none], [none], [none], 0
        yield sent_on(keys, sides, texts)

    def merged(keys, sides, texts, n):
        keys, sides = _distinct_rows(np.concatenate(keys), np.concatenate(sides))
        texts, n = _tallied(np.concatenate(texts), np.concatenate(n))
        return [keys], [sides], [texts], [n]

    def counted(held):
        (keys,), (sides,), (texts,), (n,) = merged(*held)
        first = _starts(keys)
        both = np.diff(np.r_[first, len(keys)])
        after = np.add.reduceat((sides >> np.uint64(AFTER)).astype(np.int64), first) if len(first) else both
        codes = _distinct(texts & mask)
        out = np.zeros((8, len(codes)), dtype=np.int32)
        at, group = np.searchsorted(codes, texts & mask), (texts >> np.uint64(GROUP_AT)).astype(np.int64)
        # Whatever stands in a text has a word, or its start, before it.
        out[group, at] = np.minimum(n.astype(np.int64), np.maximum(both - after, after))
        out[group + 4, at] = n
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), *map(pa.array, out)], names=["code", *COUNTS, *TEXTS])

    def count(batches):
        held, waiting, at = ([none], [none], [none], [none]), 0, None
        for batch in batches:
            for row in zip(*(batch.column(name) for name in ("part", "keys", "sides", "texts", "n"))):
                part, keys, sides, texts, n = (value.as_py() for value in row)
                if part != at:
                    yield counted(held)
                    held, waiting, at = ([none], [none], [none], [none]), 0, part
                for column, values in zip(held, (_unpack(keys), _from_planes(sides, 6), _unpack(texts), _from_planes(n, 4))):
                    column.append(values)
                waiting += len(held[0][-1])
                if waiting >= max(HELD, len(held[0][0])):
                    held, waiting = merged(*held), 0
        yield counted(held)

    packed = rows.mapInArrow(send, "part int, keys binary, sides binary, texts binary, n binary")
    columns = ", ".join(f"{name} int" for name in [*COUNTS, *TEXTS])
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, f"code long, {columns}")


def _class_counts(rows: DataFrame, sent):
    """How often each known word counts per fold and class, and at the end the sum over them of the texts that hold each."""
    size = len(sent.value[0])
    found = _counted(rows, sent, False, _parts(rows)).toArrow()
    at = found.column("code").to_numpy()
    number = np.zeros((4, size + 1))
    for group, (count, texts) in enumerate(zip(COUNTS, TEXTS)):
        number[group, at] = found.column(count).to_numpy()
        number[group, -1] = found.column(texts).to_numpy().astype(float).sum()
    return number.reshape(2, 2, size + 1)


def _shared_counts(docs: DataFrame, text, sent):
    """Different words before each known word in the whole corpus, and such pairs in all, unknown words taken as one."""
    parts, unknown = _parts(docs), len(sent.value[0])
    # As many words as codes have numbers for are counted in one pass.
    room = 1 << (63 - BESIDE)

    def passed(start):
        def run(batches):
            held = _Held(parts, by_slot=False)
            for batch in batches:
                for part in slices(batch, max_bytes=TEXT_BYTES):
                    found, texts, _ = _read(part.column("text"))
                    slot = _slots(sent.value[0], found)
                    # The start of a text is named like no word.
                    names = _before(_names(found, slot) + np.uint64(1), texts)
                    slot = np.where(slot >= 0, slot, unknown) - start
                    mine = (slot >= 0) & (slot < room)
                    yield from held.add(_codes(slot[mine], names[mine]))
            yield held.sent()

        packed = docs.select(F.col(text).alias("text")).mapInArrow(run, "part int, codes binary")
        return _beside_counts(packed, parts, min(room, unknown + 1 - start))

    counts = np.concatenate([passed(start) for start in range(0, unknown + 1, room)])
    return np.maximum(counts[:-1], 1), max(counts.sum(), 1)


def _by_class(n):
    """Counts of both classes from those of each fold and class."""
    return [n[0] + n[2], n[1] + n[3]]


def _pair_sums(pairs: DataFrame, size):
    """Per class: pairs that count once, and twice; per word, the sum of the pairs it heads and their number."""
    of = _by_class([F.col(name) for name in COUNTS])
    few = pairs.agg(*[F.count_if(n == value) for n in of for value in (1, 2)]).first()
    head = F.shiftright("code", WORD_BITS).cast("int").alias("head")
    found = pairs.groupBy(head).agg(*[F.sum(n) for n in of], *[F.count_if(n > 0).cast("int") for n in of]).toArrow()
    out, at = np.zeros((4, size)), found.column(0).to_numpy()
    for row, column in zip(out, found.columns[1:]):
        row[at] = column.to_numpy()
    return [(few[2 * i], few[2 * i + 1], out[i], out[2 + i]) for i in (0, 1)]


def _models(counts, sums, before, total):
    """Three models: as the rows of class 0 see them, each without itself, those of class 1, and other texts.

    A model has per class the discount, the texts that are taken out of counts, and, per word, its
    log-likelihood, the room for pairs after it, and the share that falls back; then how sure the difference
    of the classes is for each word, and their sizes. `counts[class]` has each word, then the sum over all words of the class.
    """
    share, sizes = before / max(before.sum(), total), counts[:, -1]

    def of_class(group, sums, less):
        once, twice, paired, heads = sums
        seen, size = group[:-1], max(float(group[-1]), 1.0)
        once, twice = once + (seen == 1).sum(), twice + (seen == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.75
        # What discounting takes from the known words goes to the shared counts.
        lost = max((seen - np.maximum(seen - discount, 0)).sum(), discount)
        seen = np.maximum(seen - less, 0)
        own = np.maximum(seen - discount, 0) / size + lost / size * share
        after = np.maximum(paired - discount * heads - less, 0)
        # A pair may follow a word more often than there are documents with the word.
        room = np.maximum(np.maximum(seen, after / 0.9), 1.0)
        return discount, less, np.log(own).astype(np.float32), room.astype(np.float32), (1 - after / room).astype(np.float32)

    for without in (0, 1, None):
        less = [int(label == without) for label in (0, 1)]
        sure = _sure([np.maximum(group[:-1] - n, 0) for group, n in zip(counts, less)], sizes)
        yield [of_class(*given) for given in zip(counts, sums, less)], sure.astype(np.float32), sizes


def _sure(counts, sizes):
    """From 0 to 1, how little an expression's counts in the two classes can be chance: by the ratio of their likelihoods."""
    both, share = counts[0] + counts[1], sizes / max(sizes.sum(), 1.0)
    ratio = sum(2 * n * np.log(np.maximum(n, 1) / np.maximum(both * part, 1e-9)) for n, part in zip(counts, share))
    ratio = np.maximum(ratio, 0)
    return ratio**2 / (ratio**2 + SURE**2)


def _word_gains(model):
    """Log-likelihood differences: of words, of falling back after a word, and of words as far as they are sure."""
    ((_, _, own, _, rest), (_, _, toxic, _, toxic_rest)), sure, _ = model
    return toxic - own, np.log(toxic_rest) - np.log(rest), (toxic - own) * sure


def _pair_gains(code, counts, model):
    """Log-likelihood differences of pairs that count `counts[class]`, and the same as far as they are sure."""
    classes, _, sizes = model
    head, tail = code >> WORD_BITS, code & ((1 << WORD_BITS) - 1)
    counts = [np.maximum(n - less, 0) for n, (_, less, *_) in zip(counts, classes)]
    logs = [
        np.log(np.maximum(n - discount, 0) / room[head] + rest[head] * np.exp(own[tail].astype(float)))
        for n, (discount, _, own, room, rest) in zip(counts, classes)]
    return logs[1] - logs[0], (logs[1] - logs[0]) * _sure(counts, sizes)


def _rows_by_part(codes, parts, chunk, counts=None):
    """Rows (part, chunk, codes, n) of codes and their counts; without counts, they are asked for."""
    order = np.argsort(codes, kind="stable")
    part = _parts_of_codes(codes[order], parts)
    order = order[np.argsort(part, kind="stable")]
    bounds = np.searchsorted(np.sort(part), np.arange(parts + 1))
    at = np.nonzero(np.diff(bounds))[0]
    pieces = [order[bounds[i]: bounds[i + 1]] for i in at]
    n = [None if counts is None else _packed_counts(counts[:, piece]) for piece in pieces]
    return pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int32()), pa.array(np.full(len(at), chunk), pa.int32()), pa.array([_steps(codes[piece]) for piece in pieces], pa.binary()),
         pa.array(n, pa.binary())], names=["part", "chunk", "codes", "n"])


def _packed_counts(counts):
    return _planes(np.ascontiguousarray(counts).reshape(-1), 4)


def _gathered(codes, n):
    """Sorted codes and their counts in both classes from packed pieces."""
    codes = np.concatenate([np.zeros(0, dtype=np.uint64), *map(_unpack, codes)])
    counts = np.concatenate([np.zeros((2, 0), dtype=np.uint64), *(_from_planes(packed, 4).reshape(2, -1) for packed in n)], axis=1)
    order = np.argsort(codes, kind="stable")
    return codes[order], counts[:, order]


def _pairs_by_part(pairs: DataFrame, parts) -> DataFrame:
    """The stored pairs in parts, (part, chunk, codes, n), with their counts in both classes; the chunk is -1."""

    def run(batches):
        for batch in batches:
            counts = np.stack(_by_class([batch.column(name).to_numpy() for name in COUNTS]))
            yield _rows_by_part(batch.column("code").to_numpy().view(np.uint64), parts, -1, counts)

    return pairs.select("code", *COUNTS).mapInArrow(run, LOOKUP)


def _with_pairs(docs: DataFrame, text, words, pairs: DataFrame, parts, weigh, score, out) -> DataFrame:
    """`score(batch, codes, weights)` over slices of all rows, with what `weigh(codes, counts)` makes of the pairs that their chunk holds."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    chunks = max(1, -(-size // CHUNK_BYTES))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    dealt = docs.withColumn(CHUNK, F.pmod(F.xxhash64(*hashed), F.lit(chunks)).cast("int"))

    def ask(table):
        codes, chunk = [np.zeros(0, dtype=np.uint64)], table.column(CHUNK)[0].as_py()
        for batch in table.to_batches():
            for part in slices(batch, text, TEXT_BYTES):
                found, texts, _ = _read(part.column(text))
                codes.append(_distinct(_pair_codes(_slots(words.value, found), texts)[1]))
        return pa.Table.from_batches([_rows_by_part(_distinct(np.concatenate(codes)), parts, chunk)])

    def answer(batches):
        at, known, pieces = None, None, []
        for batch in batches:
            for part, chunk, codes, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if part != at:
                    at, known, pieces = part, None, []
                if chunk < 0:
                    pieces.append((codes, n))
                    continue
                if known is None:
                    # All pairs of a part stand before what is asked of it.
                    known, pieces = _gathered(*zip(*pieces)) if pieces else _gathered([], []), []
                codes = _unpack(codes)
                slot = _slots(known[0], codes)
                hit = slot >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int32()), pa.array([_steps(codes[hit])], pa.binary()),
                     pa.array([_packed_counts(known[1][:, slot[hit]])], pa.binary())], names=[CHUNK, "codes", "n"])

    asked = dealt.groupBy(CHUNK).applyInArrow(ask, LOOKUP)
    met = _pairs_by_part(pairs, parts).unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "chunk")
    answers = met.mapInArrow(answer, f"`{CHUNK}` int, codes binary, n binary")
    arrow = to_arrow_schema(out)

    def run(table, answered):
        codes, counts = _gathered(answered.column("codes").to_pylist(), answered.column("n").to_pylist())
        weights = weigh(codes.astype(np.int64), counts.astype(float))
        return pa.Table.from_batches(
            [scored for batch in table.to_batches() for part in slices(batch, text, TEXT_BYTES) for scored in score(part, codes, weights)], schema=arrow)

    return dealt.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(run, out)


def _averages(array, words, gains, codes, weights):
    """Mean difference per word of each text, of its most toxic window, and of its most toxic word."""
    found, texts, bounds = _read(array)
    word_gain, back, sure_gain = gains
    word = _slots(words, found)
    plain, gain = np.zeros(len(found)), np.zeros(len(found))
    known = word >= 0
    plain[known], gain[known] = word_gain[word[known]], sure_gain[word[known]]
    fall = np.nonzero(known[1:] & known[:-1] & (texts[1:] == texts[:-1]))[0] + 1
    plain[fall] += back[word[fall - 1]]
    at, code = _pair_codes(word, texts)
    pair = _slots(codes, code)
    at, pair = at[pair >= 0], pair[pair >= 0]
    plain[at], gain[at] = weights[0][pair], weights[1][pair]
    total = np.r_[0.0, np.cumsum(plain)]
    size = np.diff(bounds)
    mean = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(size, SHORTEST)
    total = np.r_[0.0, np.cumsum(np.maximum(gain, FLOOR))]
    # Windows start every half window; the last one ends with the text.
    many = np.maximum(-(-(size - WINDOW) // (WINDOW // 2)), 0) + 1
    first = np.cumsum(many) - many
    place = np.arange(many.sum()) - np.repeat(first, many)
    length = np.repeat(size, many)
    start = np.minimum(place * (WINDOW // 2), np.maximum(length - WINDOW, 0))
    stop = np.minimum(start + WINDOW, length)
    base = np.repeat(bounds[:-1], many)
    window = (total[base + stop] - total[base + start]) / np.maximum(stop - start, SHORTEST)
    word = np.maximum.reduceat(np.append(gain, 0.0), np.minimum(bounds[:-1], len(gain)))
    return np.stack([mean, np.maximum.reduceat(window, first), np.where(size > 0, word, 0.0)], axis=1)


def _fit_curve(seen: DataFrame, rounds=50, ridge=1.0):
    """Logistic weights of the averages with an intercept, by Newton's method; averages are scaled to one deviation.

    `seen` is a stored table of the averages and the label of each row. A round is one aggregate. No average
    lowers the score: the one with the least weight is left out while that is negative.
    """
    used = list(range(len(AVERAGES)))
    while True:
        curve = _fit_averages(seen, [AVERAGES[i] for i in used], rounds, ridge)
        if not used or curve[:-1].min() >= 0:
            break
        used.pop(int(curve[:-1].argmin()))
    out = np.zeros(len(AVERAGES) + 1)
    out[[*used, -1]] = curve
    return out


def _fit_averages(seen: DataFrame, averages, rounds, ridge):
    scale = np.ones(0)
    if averages:
        scale = np.maximum(np.array(seen.agg(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in averages]).first(), dtype=float), 1e-9)
    x = [*(F.col(c) / F.lit(float(s)) for c, s in zip(averages, scale)), F.lit(1.0)]
    w, size = np.zeros(len(x)), len(x)
    penalty = np.diag([*([ridge] * len(averages)), 1e-6])
    weight = F.when(F.col("label") > 0, TOXIC_WEIGHT).otherwise(1.0)
    for _ in range(rounds):
        at = sum(column * F.lit(float(value)) for column, value in zip(x, w))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at))))
        rows = seen.select(*[column.alias(f"x{i}") for i, column in enumerate(x)], (weight * (p - F.col("label"))).alias("g"), (weight * p * (1 - p)).alias("h"))
        upper = [(i, j) for i in range(size) for j in range(i, size)]
        sums = np.array(rows.agg(
            *[F.sum(F.col("g") * F.col(f"x{i}")) for i in range(size)],
            *[F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in upper]).first(), dtype=float)
        grad, hess = sums[:size] + penalty @ w, penalty.copy()
        for (i, j), value in zip(upper, sums[size:]):
            hess[i, j] += value
            hess[j, i] = hess[i, j]
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / scale, w[-1]]


def _score(features, curve):
    return 1 / (1 + np.exp(-np.clip(features @ curve[:-1] + curve[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label="toxic", key="doc_id", text="text"):
    """A model for `score_documents`, or None without rows of both classes."""
    context = docs.sparkSession.sparkContext
    rows = labelled_rows(docs, labels, label, key, text)
    if rows.select("label").distinct().count() < 2:
        return None
    words = _vocabulary(rows)
    sent = context.broadcast((words, np.zeros(0, dtype=np.uint64)))
    counts = _class_counts(rows, sent)
    before, total = _shared_counts(docs, text, sent)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(_parts(rows), -(-size // PART_BYTES))
    pairs = write_and_read(_counted(rows, sent, True, parts).select("code", *COUNTS), "pairs")
    *without, full = _models(counts.sum(axis=0), _pair_sums(pairs, len(words)), before, total)
    known = context.broadcast(words)
    models = context.broadcast(without)
    gains = context.broadcast([_word_gains(model) for model in without])

    def weigh(codes, counts):
        return [_pair_gains(codes, counts, model) for model in models.value]

    def averages(part, codes, weights):
        for label in (0, 1):
            mine = part.filter(pc.equal(part.column("label"), label))
            if mine.num_rows:
                found = _averages(mine.column("text"), known.value, gains.value[label], codes, weights[label])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(column) for column in found.T.copy()), mine.column("label")], names=[*AVERAGES, "label"])

    out = T.StructType([*(T.StructField(name, T.DoubleType()) for name in AVERAGES), T.StructField("label", T.IntegerType())])
    seen = _with_pairs(rows, "text", known, pairs, parts, weigh, averages, out)
    curve = _fit_curve(write_and_read(seen, "averages"))
    return known, context.broadcast((full, _word_gains(full), curve)), pairs, parts


def score_documents(docs: DataFrame, model, text="text", into="toxicity", keep=None) -> DataFrame:
    """Add the score to every row; `keep` names the columns to go on with."""
    fields = [f for f in docs.schema if f.name != into and (keep is None or f.name in keep)]
    out = T.StructType([*fields, T.StructField(into, T.DoubleType())])
    if model is None:
        return docs.select(*[f.name for f in fields]).withColumn(into, F.lit(0.0))
    arrow, names = to_arrow_schema(out), [f.name for f in fields]
    known, tables, pairs, parts = model

    def weigh(codes, counts):
        return _pair_gains(codes, counts, tables.value[0])

    def run(part, codes, weights):
        _, gains, curve = tables.value
        scores = _score(_averages(part.column(text), known.value, gains, codes, weights), curve)
        columns = [part.column(n).cast(f.type) for n, f in zip(names, arrow)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], schema=arrow)

    return _with_pairs(docs.select(*[F.col(f"`{n}`") for n in dict.fromkeys([*names, text])]), text, known, pairs, parts, weigh, run, out)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: whether it is held out, its score, and the prediction."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels), into="score", keep=["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below the threshold."""
    scored = score_documents(docs, train(docs, labels), into=SCORE)
    return scored.where(F.col(SCORE) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
