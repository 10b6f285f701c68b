"""Prompt assembly and answers."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two prompt templates of the reference.
PLAIN_TEMPLATE = (
    "Context information is below.\n"
    "---------------------\n"
    "{context_str}\n"
    "---------------------\n"
    "Given the context information and not prior knowledge, answer the query.\n"
    "Query: {query_str}\n"
    "Answer:"
)
EVIDENCE_TEMPLATE = (
    "Context information is below.\n"
    "---------------------\n"
    "{context_str}\n"
    "---------------------\n"
    "\n"
    "The following aggregate statistics from the parliamentary database "
    "are also available to help you give a comprehensive answer.\n"
    "---------------------\n"
    "{evidence_str}\n"
    "---------------------\n"
    "Given the context information, statistics, and not prior knowledge, "
    "answer the query.\n"
    "Query: {query_str}\n"
    "Answer:"
)
# Fixed value: what stands between two chunk texts.
CONTEXT_SEPARATOR = "\n\n"


def _fill(template, **values):
    """Template to a column: literal text between the named columns."""
    parts, rest = [], template
    while "{" in rest:
        literal, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(literal), values[name]]
    return F.concat(*parts, F.lit(rest))


def build_prompts(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Add `prompt` to the queries.

    `ranked` holds the few chunks kept per query (`query_id`, `rank`, `text`);
    their texts enter in rank order. A query with `evidence` gets the second
    template. A query that retrieved nothing keeps an empty context.
    """
    contexts = ranked.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda c: c["text"]), CONTEXT_SEPARATOR
        ).alias("_context")
    )
    context = F.coalesce("_context", F.lit(""))
    # A request without a query still gets a prompt, with nothing in its place.
    query = F.coalesce("query", F.lit(""))
    plain = _fill(PLAIN_TEMPLATE, context_str=context, query_str=query)
    prompt = plain
    if "evidence" in queries.columns:
        full = _fill(
            EVIDENCE_TEMPLATE, context_str=context, evidence_str=F.col("evidence"), query_str=query
        )
        has_evidence = F.col("evidence").isNotNull() & (F.col("evidence") != "")
        prompt = F.when(has_evidence, full).otherwise(plain)
    return queries.join(contexts, "query_id", "left").withColumn("prompt", prompt).drop("_context")


def echo_generator():
    """A stand-in generator: answers with the prompt itself."""
    return lambda prompts: list(prompts)


def answer(prompts: DataFrame, generator=echo_generator, sources: DataFrame | None = None) -> DataFrame:
    """Add `answer`, and with `sources` (see `source_rows`) an array of them.

    `generator()` runs once per task and returns a function from a list of
    prompts to a list of texts.
    """
    schema = T.StructType(prompts.schema.fields + [T.StructField("answer", T.StringType())])

    def run(frames):
        model = generator()
        for frame in frames:
            yield frame.assign(answer=pd.Series(model(frame["prompt"].tolist()), index=frame.index, dtype="object"))

    answered = prompts.mapInPandas(run, schema)
    if sources is None:
        return answered
    fields = [c for c in sources.columns if c != "query_id"]
    listed = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("sources"))
    return answered.join(listed, "query_id", "left")
