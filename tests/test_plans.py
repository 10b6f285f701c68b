"""Physical plans: what is pushed down, what is limited early, what stays in the JVM."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusqa import schemas
from corpusqa.operators import chunking, dense
from corpusqa.operators import documents as docs
from corpusqa.operators import entities as ent
from corpusqa.session import broadcast_within, scratch_path

SF_DIR = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def planned(spark, name):
    return plan(entry.queries()[name](spark, SF_DIR))


@pytest.mark.parametrize("name", [
    "member_profile_recent", "ministry_profile_recent", "overlap_profile_recent",
    "member_profile_top_ministries", "ministry_profile_top_members", "build_questions", "dense_topk", "bm25_topk",
])
def test_rank_limits_apply_before_the_shuffle(spark, name):
    text = planned(spark, name)
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


@pytest.mark.parametrize("name", [
    "canonical_names", "build_questions", "build_links", "build_counts", "member_profile_text", "ministry_profile_text",
    "overlap_profile_text", "evidence_packets", "flatten_metadata", "members_filter", "text_measures", "engine_totals",
])
def test_relational_queries_have_no_python_and_no_cross_join(spark, name):
    text = planned(spark, name)
    assert not any(node in text for node in PYTHON_NODES)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", [
    "member_profile_breakdowns", "member_profile_top_ministries", "overlap_profile_types", "overlap_profile_text",
])
def test_profiles_of_many_keys_are_counted_in_bounded_tasks(spark, name):
    assert "REPARTITION_BY_NUM" in planned(spark, name)


def test_a_first_rows_read_keeps_only_these(spark):
    text = planned(spark, "first_documents")
    assert "TakeOrderedAndProject" not in text and "Sort [text" not in text
    assert text.count("Exchange SinglePartition") == 1  # one row per file


def test_the_splitter_runs_once(spark):
    df = spark.createDataFrame([("a", "One. Two.")], "qa_id string, text string")
    assert plan(chunking.chunk_documents(df)).count("ArrowEvalPython") == 1


def test_filters_and_columns_reach_the_scan(spark):
    path = scratch_path(spark, "plan")
    spark.createDataFrame([("1", "t", 1, 1, 1, "S", "d", "s", "m", ["a"])], schemas.CORPUS).write.parquet(path)
    corpus = spark.read.parquet(path)
    text = plan(docs.keyed_questions(corpus).select("ques_no"))
    assert "IsNotNull(lok_no), IsNotNull(session_no), IsNotNull(ques_no)" in text
    text = plan(ent.build_questions(corpus, [F.desc("date")]))
    assert "full_text" not in text and "members" not in text
    # Untyped questions bypass the shuffle.
    assert text.count("Exchange hashpartitioning") == 1 and "IsNull(type)" in text


def test_broadcasts_are_bounded(spark):
    df = spark.range(10).withColumnRenamed("id", "k").repartition(2)
    small = plan(df.join(broadcast_within(df, 10), "k", "left_semi"))
    assert "BroadcastHashJoin" in small
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan(df.join(broadcast_within(df, 9), "k", "left_semi"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ministries_are_pushed_whatever_their_number(spark):
    path = scratch_path(spark, "plan")
    rows = [("c", [1.0], "m", f"src{i}") for i in range(60)]
    spark.createDataFrame(rows, "chunk_id string, embedding array<float>, members string, ministry string").write.parquet(path)
    chunks = spark.read.parquet(path)
    queries = [(i, [1.0], f"src{i}" if i else None) for i in range(41)]
    found = dense.dense_topk(chunks, spark.createDataFrame(queries, "query_id int, embedding array<float>, ministry string"))
    text = plan(found)
    assert "PushedFilters" in text and "In(ministry, [" in text
    assert found.where("query_id > 0").count() == 40 and found.where("query_id = 0").count() == 10
