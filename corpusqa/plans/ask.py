"""From requests to answers: filter, retrieve, rerank, add evidence, prompt, answer."""

from pyspark.sql import DataFrame

from .. import schemas
from ..operators import prompts as pm
from ..operators.entities import resolve_requests
from ..operators.evidence import evidence_packets, source_rows
from ..operators.rerank import rerank
from ..session import write_and_read
from .evidence import evidence_for
from .retrieve import retrieve


def ranked_contexts(requests, collection, model_factory, *, scorer=None, k=schemas.TOP_K, top_n=schemas.RERANK_TOP_N, **options):
    """The few best chunks per request after reranking, with their columns."""
    found = retrieve(requests, collection, model_factory, k=k, **options)
    # Stored, so that the scorer sees each pair once; prompts and sources both read it.
    return write_and_read(rerank(found.join(requests.select("query_id", "query"), "query_id"), scorer, top_n), "reranked")


def ask(
    requests: DataFrame, collection, model_factory, *, profiles=None, tables=None, aliases=None, scorer=None,
    generator=pm.echo_generator, top_q=schemas.TOP_QUESTIONS, **options,
) -> DataFrame:
    """Answers with sources for a table of requests (`query_id`, `query`, `mp`, `ministry`).

    `profiles` is the triple of member, ministry and overlap profiles; with it,
    requests that name a member or ministry carry statistics in their prompt.
    `tables`, the pair of questions and asked questions, serves where no profiles
    are stored: only what the requests name is profiled.
    """
    rows = resolve_requests(requests, aliases) if aliases is not None else requests
    best = ranked_contexts(rows, collection, model_factory, scorer=scorer, **options)
    if profiles is not None:
        rows = evidence_packets(rows, *profiles, top_q=top_q)
    elif tables is not None:
        rows = evidence_for(rows, *tables, top_q=top_q)
    return pm.answer(pm.build_prompts(rows, best), generator, source_rows(best))
