"""Retrieval evaluation: P@k, Hit@1 and Hit@k over a table of test cases."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import broadcast_within
from .entities import MAX_BROADCAST_NAMES

UNFILTERED, FILTERED = "unfiltered", "filtered"


def effective_expected(cases: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace the expected members by the member's full alias list.

    Only where a case expects members and its member has aliases. Adds
    `names`, the alias list or the name itself, for filtering.
    """
    lookup = broadcast_within(aliases.withColumnRenamed("canonical", "mp"), MAX_BROADCAST_NAMES)
    expected = F.col("expected")
    members = F.when(
        F.col("aliases").isNotNull() & expected["members_contains_any"].isNotNull(), F.col("aliases")
    ).otherwise(expected["members_contains_any"])
    own = F.when(F.col("mp") != "", F.array("mp"))
    return (
        cases.join(lookup, "mp", "left")
        .withColumn("expected", F.struct(
            members.alias("members_contains_any"),
            expected["ministry_eq"].alias("ministry_eq"),
            expected["text_contains_any"].alias("text_contains_any"),
        ))
        .withColumn("names", F.coalesce("aliases", own))
        .drop("aliases")
    )


def _filled(col):
    return F.coalesce(F.col(col), F.lit(""))


def _member_ok(expected):
    members = F.lower(tx.collapse(_filled("members")))
    return F.exists(expected["members_contains_any"], lambda n: F.contains(members, F.lower(tx.collapse(n))))


def _ministry_ok(expected):
    return tx.collapse(_filled("ministry")) == tx.collapse(expected["ministry_eq"])


def _text_ok(expected):
    # The terms are lower-cased only; whitespace is collapsed in the text alone.
    text = F.lower(tx.collapse(F.concat(_filled("text"), F.lit(" "), _filled("subject"))))
    return F.exists(expected["text_contains_any"], lambda t: F.contains(text, F.lower(t)))


def chunk_matches(expected="expected") -> Column:
    """True where a chunk meets every expectation that is set."""
    e = F.col(expected)
    return (
        F.coalesce(_member_ok(e), F.lit(True))
        & F.coalesce(_ministry_ok(e), F.lit(True))
        & F.coalesce(_text_ok(e), F.lit(True))
    )


def failure_reasons(expected="expected") -> Column:
    """Why a chunk does not match: the value that failed, per expectation."""
    e = F.col(expected)

    def because(ok, name):
        return F.when(~F.coalesce(ok, F.lit(True)), F.concat(F.lit(name + "='"), _filled(name), F.lit("'")))

    reasons = F.array(
        because(_member_ok(e), "members"), because(_ministry_ok(e), "ministry"), because(_text_ok(e), "subject")
    )
    return F.array_join(F.array_compact(reasons), "; ")


def eval_requests(cases: DataFrame) -> DataFrame:
    """Every case unfiltered, and once more with its filters where it has any.

    Both modes of all cases then run as one batch, in one pass over the
    collection. `query_id` is `mode:id`.
    """
    has_mp = F.col("mp").isNotNull() & (F.col("mp") != "")
    has_ministry = F.col("ministry").isNotNull() & (F.col("ministry") != "")
    no_names = F.lit(None).cast("array<string>")
    plain = cases.withColumns({"mode": F.lit(UNFILTERED), "names": no_names, "ministry": F.lit(None).cast("string")})
    filtered = cases.where(has_mp | has_ministry).withColumn("mode", F.lit(FILTERED))
    both = plain.unionByName(filtered.select(*plain.columns))
    return both.withColumn("query_id", F.concat("mode", F.lit(":"), "id"))


def judge(requests: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Retrieved chunks with `matched`. `retrieved` has `query_id`, `rank` and chunk columns."""
    wanted = requests.select("query_id", "id", "category", "mode", "expected")
    return retrieved.join(wanted, "query_id").withColumn("matched", chunk_matches())


def score_retrieval(requests: DataFrame, judged: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """Metrics per case and mode; a request that retrieved nothing scores 0.

    P@k divides by the rows returned. `latency` is `(query_id, latency_ms)`
    where the caller measured it.
    """
    hit = F.col("matched").cast("int")
    metrics = judged.groupBy("query_id").agg(
        F.avg(hit).alias("_p"),
        F.max(F.when(F.col("rank") == 1, hit)).alias("_h1"),
        F.max(hit).alias("_hk"),
        F.countDistinct("qa_id").alias("_docs"),
        F.count("*").alias("_k"),
    )
    out = requests.select("query_id", "id", "mode", "query", "category").join(metrics, "query_id", "left")
    columns = [
        F.coalesce("_p", F.lit(0.0)).alias("precision_at_k"),
        (F.coalesce("_h1", F.lit(0)) == 1).alias("hit_at_1"),
        (F.coalesce("_hk", F.lit(0)) == 1).alias("hit_at_k"),
        F.coalesce("_docs", F.lit(0)).alias("unique_docs"),
        F.coalesce("_k", F.lit(0)).alias("k"),
    ]
    if latency is not None:
        out = out.join(latency, "query_id", "left")
        columns.append(F.col("latency_ms"))
    return out.select("query_id", F.col("id").alias("test_id"), "mode", "query", "category", *columns)


def summary_by_mode(scores: DataFrame) -> DataFrame:
    """Means per mode."""
    aggregates = [
        F.count("*").alias("count"),
        F.avg("precision_at_k").alias("avg_precision_at_k"),
        F.avg(F.col("hit_at_1").cast("int")).alias("avg_hit_at_1"),
        F.avg(F.col("hit_at_k").cast("int")).alias("avg_hit_at_k"),
        F.avg("unique_docs").alias("avg_unique_docs"),
    ]
    if "latency_ms" in scores.columns:
        aggregates.append(F.avg("latency_ms").alias("avg_latency_ms"))
    return scores.groupBy("mode").agg(*aggregates)


def report_rows(scores: DataFrame) -> DataFrame:
    """Per-query report, each case with its unfiltered row first."""
    columns = [
        F.col("test_id"), F.col("category"), F.col("mode"),
        tx.fixed("precision_at_k", 2).alias("p_at_k"),
        F.when(F.col("hit_at_1"), "Y").otherwise("N").alias("hit_1"),
        F.when(F.col("hit_at_k"), "Y").otherwise("N").alias("hit_k"),
        F.col("unique_docs").alias("docs"),
    ]
    if "latency_ms" in scores.columns:
        columns.append(F.concat(tx.fixed("latency_ms", 0), F.lit("ms")).alias("latency"))
    return scores.select(*columns).orderBy("test_id", F.desc("mode"))


def failures(scores: DataFrame, judged: DataFrame) -> DataFrame:
    """Every chunk of the queries below full precision, with pass or fail and reasons.

    The layout shows the ministry and the first 60 characters of the members.
    """
    imperfect = scores.where(F.col("precision_at_k") < 1).select("query_id")
    return judged.join(imperfect, "query_id", "left_semi").select(
        F.col("id").alias("test_id"), "mode", "rank", "qa_id", _filled("ministry").alias("ministry"),
        F.substring(_filled("members"), 1, 60).alias("members"),
        F.when(F.col("matched"), "PASS").otherwise("FAIL").alias("verdict"),
        failure_reasons().alias("reasons"),
    )


def compare_searches(scores: DataFrame, searches=("dense", "hybrid")) -> DataFrame:
    """Mean P@k of two searches per mode and their difference. `scores` has `search`."""
    first, second = searches
    table = scores.groupBy("mode").pivot("search", list(searches)).agg(F.avg("precision_at_k"))
    return table.withColumn("delta", F.col(second) - F.col(first))
