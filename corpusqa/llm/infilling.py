"""Fill-in-the-middle transformation of documents.

A text is cut into units, a word with the blanks before it (or the blanks at the
end), and two seeded cuts make a prefix, a middle and a suffix of whole units. The
parts are put in another order between sentinels, so that a model learns to write
the middle from what stands around it:

    plain   the text as it is
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

Everything is array work on slices of Arrow batches: units are split into lists,
the lists are flattened with the number of their text, every unit gets its ordinal
and from it its part, and the units of one part are gathered into lists again and
joined. Bytes are split at a byte that UTF-8 never holds, so no text can clash.

Cuts and form come from a hash of seed and key alone: reruns agree, whatever the
partitions. Texts that hold a sentinel stay plain, so `restored` can find the parts
of all others: no sentinel can arise where two parts touch.

Defined results: null and empty texts are empty and plain with no unit; a null key
counts as empty text. Rows with equal keys and texts come out alike; every row gives
one. Empty tables give no rows. Other columns are kept, except for those named like
the results.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .words import slices

# Fixed values of the transformation.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"

SEED = 42
INFILL_PERCENT = 50
SPM_PERCENT = 80
# A byte that no UTF-8 text holds.
CUT = b"\xff"
RESULTS = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


def seeded_numbers(key: Column, seed=SEED, many=4):
    """`many` numbers of 32 bits from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(many)])


def _units(texts):
    """Units of binary texts as one flat array, the text of each, and how many each text has."""
    marked = pc.replace_substring_regex(texts, pattern=UNIT, replacement=rb"\1" + CUT)
    lists = pc.split_pattern(marked, pattern=CUT)
    # What follows the last cut is empty.
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) - 1
    parents = pc.list_parent_indices(lists).to_numpy()
    first = np.cumsum(sizes + 1) - (sizes + 1)
    ordinals = np.arange(len(parents)) - first[parents]
    real = ordinals < sizes[parents]
    return pc.list_flatten(lists).filter(pa.array(real)), parents[real], ordinals[real], sizes


def _joined(units, parents, mask, rows):
    """The units under a mask, joined per text."""
    counts = np.bincount(parents[mask], minlength=rows)
    offsets = np.r_[0, np.cumsum(counts)]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), units.filter(pa.array(mask)))
    return pc.binary_join(lists, pa.scalar(b"", units.type))


def _chars(pieces):
    return pc.utf8_length(pieces.cast(pa.large_string())).cast(pa.int64())


def _transform(texts, numbers, infill, spm):
    """Result columns of a slice: `texts` binary without nulls, `numbers` of shape (rows, 4)."""
    rows = len(texts)
    units, parents, ordinals, sizes = _units(texts)
    low = np.minimum(numbers[:, 0] % (sizes + 1), numbers[:, 1] % (sizes + 1))
    high = np.maximum(numbers[:, 0] % (sizes + 1), numbers[:, 1] % (sizes + 1))
    role = (ordinals >= low[parents]).astype(np.int8) + (ordinals >= high[parents])
    prefix, middle, suffix = (_joined(units, parents, role == r, rows) for r in range(3))
    plain = (sizes == 0) | (numbers[:, 2] % 100 >= infill)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain |= pc.match_substring(texts, pattern=mark).to_numpy(zero_copy_only=False)
    form = np.where(plain, "plain", np.where(numbers[:, 3] % 100 < spm, "spm", "psm"))
    p, s, m, nothing = (pa.scalar(mark.encode(), texts.type) for mark in (PREFIX, SUFFIX, MIDDLE, ""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
    output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(form == "spm"), spm, psm))
    hidden, none = pa.array(plain), pa.scalar(None, pa.int64())
    return [pa.array(sizes), pa.array(form), pc.if_else(hidden, none, _chars(prefix)), pc.if_else(hidden, none, _chars(middle)), output.cast(pa.large_string())]


def infill(docs: DataFrame, key="doc_id", text="text", seed=SEED, infill_percent=INFILL_PERCENT, spm_percent=SPM_PERCENT) -> DataFrame:
    """Add units, form, characters of prefix and middle, and the output text to every row."""
    kept = [f for f in docs.schema if f.name not in RESULTS]
    # Unnamed columns travel under numbers, so no caller's name can clash.
    numbered = docs.select(
        *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(f"`{text}`").alias("text"),
        seeded_numbers(F.col(f"`{key}`"), seed).alias("numbers"))
    out = T.StructType([*kept, *[T.StructField(name, kind) for name, kind in RESULTS.items()]])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
                numbers = pc.list_flatten(part.column("numbers")).to_numpy().reshape(-1, 4)
                columns = [part.column(f"c{i}") for i in range(len(kept))] + _transform(texts, numbers, infill_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return numbered.mapInArrow(run, out)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def infill_table(docs: DataFrame) -> DataFrame:
    """One row per document: units, form, cuts, and digests of the output and of the text rebuilt from it."""
    made = infill(docs.select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
