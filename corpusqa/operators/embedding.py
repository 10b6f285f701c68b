"""Embedding with a model the caller supplies, and a built-in stand-in."""

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas


def embed(
    df: DataFrame, model_factory, *, id_col="chunk_id", text_col="text",
    prefix=schemas.PASSAGE_PREFIX, batch_size=schemas.EMBED_BATCH, normalize=True, keep=(),
) -> DataFrame:
    """`(id, embedding)` of every text, with the columns named in `keep`.

    `model_factory()` runs once per task and returns a function from a list of
    texts to a matrix with one row each. Vectors are unit length and float32.
    """
    columns = list(dict.fromkeys([id_col, *keep]))
    schema = T.StructType(
        [df.schema[c] for c in columns] + [T.StructField("embedding", T.ArrayType(T.FloatType(), False))]
    )

    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        model = model_factory()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                vectors = np.asarray(model([prefix + t for t in part.column(text_col).to_pylist()]), dtype=np.float64)
                if normalize:
                    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                    vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
                offsets = np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32)
                made = pa.ListArray.from_arrays(offsets, vectors.astype(np.float32).reshape(-1), type=arrow.field("embedding").type)
                kept = [part.column(c) for c in columns]
                kept = [c if c.type == f.type else c.cast(f.type) for c, f in zip(kept, arrow)]
                yield pa.RecordBatch.from_arrays([*kept, made], schema=arrow)

    return df.select(*dict.fromkeys([*columns, text_col])).where(F.col(text_col).isNotNull()).mapInArrow(run, schema)


def embed_queries(queries: DataFrame, model_factory, **options) -> DataFrame:
    """Add `embedding` to the queries, with the query prefix and the same model; null for a null query.

    The columns travel with the texts, so rows are never paired by id: repeated
    and null ids keep their own vectors.
    """
    fields = [c for c in queries.columns if c != "embedding"]
    found = embed(
        queries, model_factory, id_col=fields[0], keep=fields, text_col="query", prefix=schemas.QUERY_PREFIX, **options)
    rest = queries.select(*fields).where(F.col("query").isNull()).withColumn("embedding", F.lit(None).cast(found.schema["embedding"].dataType))
    return found.unionByName(rest)


def hashing_model(dim=schemas.EMBED_DIM):
    """Factory of a feature-hashing model (Weinberger et al., 2009).

    A stand-in where no model weights are at hand: each term adds its count,
    signed, to one bucket; both come from the MD5 of the term.
    """

    def factory():
        import pyarrow as pa
        import pyarrow.compute as pc

        word = re.compile(r"[^\W_]+")

        @lru_cache(maxsize=1 << 16)
        def place(term):
            digest = hashlib.md5(term.encode("utf-8")).hexdigest()
            return int(digest[:8], 16) % dim, 1.0 if int(digest[8], 16) % 2 == 0 else -1.0

        def model(texts):
            found = [word.findall(text.lower()) for text in texts]
            sizes = [len(terms) for terms in found]
            coded = pc.dictionary_encode(pa.array([t for terms in found for t in terms], type=pa.string()))
            # Each distinct term is hashed once per batch.
            places = np.array([place(t) for t in coded.dictionary.to_pylist()]).reshape(-1, 2)
            codes = coded.indices.to_numpy()
            cells = np.repeat(np.arange(len(texts)), sizes) * dim + places[codes, 0].astype(np.int64)
            return np.bincount(cells, weights=places[codes, 1], minlength=len(texts) * dim).reshape(len(texts), dim)

        return model

    return factory
