"""Sentence-aware chunking with overlap.

A sentence ends after a token that ends in `.`, `!` or `?`, or at a line break.
Tokens are runs of non-whitespace. Sentences longer than a chunk are cut every
`size` tokens; pieces are then packed in order, and a chunk starts with the last
pieces of the one before as far as they fit in the overlap.

The packing is sequential within one document, so it runs in an Arrow function over
the text column, which cuts a part with a bounded size of text at a time; metadata columns stay
in the JVM and nothing is shuffled.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.batches import parts
from .documents import drop_short_docs, flatten_metadata, with_qa_id

# Bytes of text that are cut together: as lists of tokens they are many times as large.
TEXT_BYTES = 1 << 20


def _pieces(text, size):
    """Sentences as token lists, none longer than `size`."""
    for line in text.split("\n"):
        sentence = []
        for token in line.split():
            sentence.append(token)
            if token[-1] in ".!?" or len(sentence) == size:
                yield sentence
                sentence = []
        if sentence:
            yield sentence


def pack(text, size, overlap):
    """Chunks of one document as `(text, n_tokens, n_repeated)`."""
    chunks, current, total, repeated = [], [], 0, 0

    def close():
        chunks.append((" ".join(" ".join(p) for p in current), total, repeated))

    for piece in _pieces(text, size):
        if total + len(piece) > size:
            close()
            room = min(overlap, size - len(piece))
            tail, repeated = [], 0
            for previous in reversed(current):
                if repeated + len(previous) > room:
                    break
                tail.append(previous)
                repeated += len(previous)
            current, total = tail[::-1], repeated
        current.append(piece)
        total += len(piece)
    if current:
        close()
    return chunks


def split_text(size, overlap):
    """Column function: text to its chunks, an array of structs."""

    @F.arrow_udf("array<struct<text:string,n_tokens:int,n_repeated:int>>")
    def split(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            for part in parts(pa.RecordBatch.from_arrays([column], names=["text"]), "text", TEXT_BYTES):
                chunks = [[] if t is None else pack(t, size, overlap) for t in part.column("text").to_pylist()]
                bounds = np.cumsum([0, *map(len, chunks)])
                found = list(zip(*(c for cut in chunks for c in cut))) or [(), (), ()]
                made = [pa.array(values, kind) for values, kind in zip(found, (pa.string(), pa.int32(), pa.int32()))]
                yield pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(made, names=["text", "n_tokens", "n_repeated"]))

    return split


def chunk_documents(
    df: DataFrame, text_col="text", *, size=schemas.CHUNK_SIZE, overlap=schemas.CHUNK_OVERLAP, counts=False
) -> DataFrame:
    """One row per chunk: `chunk_id`, `chunk_no`, the chunk text and all other columns.

    `df` has `qa_id` and the text. Ids are `qa_id#chunk_no`, so a rerun gives
    the same ones; where `qa_id` is empty a digest of the text stands for it,
    so documents without an id stay apart. `counts` adds the tokens of a chunk
    and those it repeats.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    key = F.when(F.col("qa_id") == "", F.md5(text_col)).otherwise(F.col("qa_id"))
    # What the caller's columns are called doesn't matter.
    own = ["corpusqa key", "corpusqa chunks", "corpusqa number", "corpusqa chunk"]
    rows = df.where(F.col(text_col).isNotNull()).withColumns({own[0]: key, own[1]: split_text(size, overlap)(F.col(text_col))})
    # An outer explode adds no size filter, which would run the splitter twice.
    out = rows.select(own[0], *rest, F.posexplode_outer(own[1]).alias(*own[2:])).where(F.col(own[2]).isNotNull())
    chunk = F.col(own[3])
    extra = [chunk["n_tokens"].alias("n_tokens"), chunk["n_repeated"].alias("n_repeated")] if counts else []
    chunk_id = F.concat(own[0], F.lit("#"), F.col(own[2]).cast("string"))
    return out.select(chunk_id.alias("chunk_id"), F.col(own[2]).alias("chunk_no"), *rest, chunk["text"].alias("text"), *extra)


def corpus_to_chunks(corpus: DataFrame, *, min_chars=schemas.MIN_CHARS, **chunking) -> DataFrame:
    """Corpus to chunk table: drop short documents, flatten metadata, chunk."""
    rows = flatten_metadata(with_qa_id(drop_short_docs(corpus, min_chars=min_chars)))
    return chunk_documents(rows.withColumnRenamed("full_text", "text"), **chunking).select(
        *schemas.CHUNKS.fieldNames()
    )
