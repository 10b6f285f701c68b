"""Readers, writers, and ingestion that can be stopped and started."""

import json

import pytest
from pyspark.sql import functions as F

from corpusqa import schemas
from corpusqa.operators import embedding
from corpusqa.operators import incremental as inc
from corpusqa.operators.chunking import corpus_to_chunks
from corpusqa.operators.entities import asked_questions
from corpusqa.plans import ask, bucketed, ingest
from corpusqa.session import CLUSTER_CONF
from corpusqa.sources import readers, writers
from corpusqa.streaming import ingest as streaming

MODEL = embedding.hashing_model(8)


def corpus(spark, ids):
    rows = [(str(i), f"Document {i} speaks. " * (10 + i), 17, 1, i, "S", f"2020-01-{i + 1:02d}", "sub", "M", [f"Member {i % 3}"]) for i in ids]
    return spark.createDataFrame(rows, schemas.CORPUS)


def test_registry_by_term_directory(spark, tmp_path):
    for term, rows in {"16": [{"mpNo": 1, "mpName": "A"}, {"mpNo": 2}], "17": [{"mpNo": 1, "mpName": "B"}], "notes": [{"mpNo": 9, "mpName": "Z"}]}.items():
        (tmp_path / term).mkdir()
        (tmp_path / term / "members.json").write_text(json.dumps(rows))
        (tmp_path / term / "ministries.json").write_text(json.dumps([{"minName": f"M{term}"}]))
    (tmp_path / "18").mkdir()
    (tmp_path / "18" / "members.json").write_text("[{broken")
    got = {(r["lok"], r["mpNo"], r["mpName"]) for r in readers.read_registry(spark, f"{tmp_path}/*/members.json").collect() if r["mpNo"]}
    assert got == {(16, 1, "A"), (16, 2, None), (17, 1, "B")}
    assert {r["minName"] for r in readers.read_ministries(spark, f"{tmp_path}/*/ministries.json").collect()} == {"M16", "M17"}


def test_registry_keeps_file_order(spark, tmp_path):
    (tmp_path / "17").mkdir()
    (tmp_path / "17" / "members.json").write_text(json.dumps([{"mpNo": 1, "mpName": n} for n in "CAB"]))
    rows = readers.read_registry(spark, f"{tmp_path}/*/members.json").orderBy("pos").collect()
    assert [r["mpName"] for r in rows] == ["C", "A", "B"]


def test_eval_cases_with_missing_fields(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([
        {"id": "q1", "query": "?", "category": "c", "mp": "X", "expected": {"members_contains_any": ["X"]}, "notes": "n"},
        {"id": "q2", "query": "?", "category": "c", "ministry": "A  B", "expected": {"ministry_eq": "A  B", "text_contains_any": ["t"]}},
    ]))
    one, two = readers.read_eval_cases(spark, str(path)).orderBy("id").collect()
    assert one["ministry"] is None and one["expected"]["ministry_eq"] is None and one["expected"]["members_contains_any"] == ["X"]
    assert two["mp"] is None and two["notes"] == "" and two["ministry"] == "A  B"


def test_corpus_fields_may_be_missing_and_the_limit_follows_file_order(spark, tmp_path):
    path = str(tmp_path / "corpus")
    spark.range(50).select(F.col("id"), F.lit("t").alias("full_text"), F.lit("a, b").alias("members")).coalesce(1).write.parquet(path)
    df = readers.read_corpus(spark, path, limit=3)
    assert [r["id"] for r in df.collect()] == ["0", "1", "2"]
    assert df.columns == schemas.CORPUS.fieldNames() and df.first()["members"] == "a, b" and df.first()["lok_no"] is None


def test_steps_continue_where_the_tables_stand(spark, tmp_path):
    root = str(tmp_path)
    calls = spark.sparkContext.accumulator(0)

    def counting():
        model = MODEL()

        def run(texts):
            calls.add(len(texts))
            return model(texts)

        return run

    chunks = ingest.chunk_step(corpus(spark, range(4)), f"{root}/chunks", size=20, overlap=4)
    vectors = ingest.embed_step(chunks, f"{root}/vectors", counting)
    n = chunks.count()
    assert n > 4 and calls.value == n and ingest.index_step(chunks, vectors, f"{root}/collection").count() == n
    more = ingest.chunk_step(corpus(spark, range(6)), f"{root}/chunks", size=20, overlap=4)
    vectors = ingest.embed_step(more, f"{root}/vectors", counting)
    total = more.count()
    collection = ingest.index_step(more, vectors, f"{root}/collection")
    assert calls.value == total and collection.count() == total and collection.select("chunk_id").distinct().count() == total
    again = ingest.index_step(more, vectors, f"{root}/collection", recreate=True)
    assert again.count() == total


def collected(spark, target):
    return {r["chunk_id"]: r["text"] for r in streaming.read_collection(spark, target).collect()}


def test_two_stream_runs_equal_one(spark, tmp_path):
    source, target, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"

    def run():
        streaming.ingest_stream(
            spark, source, schemas.CORPUS, target, checkpoint, MODEL, files_per_batch=1, size=20, overlap=4).awaitTermination()

    corpus(spark, range(3)).coalesce(1).write.mode("append").parquet(source)
    run()
    # The second file repeats a document already ingested.
    corpus(spark, range(2, 5)).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    expected = {r["chunk_id"]: r["text"] for r in corpus_to_chunks(corpus(spark, range(5)), size=20, overlap=4).collect()}
    assert collected(spark, target) == expected
    assert streaming.read_collection(spark, target).count() == len(expected)


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    target = f"{tmp_path}/out"
    for batch_id in (0, 1, 1, 0):
        streaming.ingest_batch(corpus(spark, [batch_id, 5]), batch_id, target, MODEL, size=20, overlap=4)
    assert set(r["qa_id"] for r in streaming.read_collection(spark, target).collect()) == {"0", "1", "5"}
    assert streaming.read_collection(spark, target).groupBy("chunk_id").count().where("count > 1").count() == 0


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.sql(f"create database if not exists meta location '{tmp_path}/meta.db'")
    questions = spark.createDataFrame([(1, 1, i, "S", "d", "m", "s") for i in range(20)], schemas.QUESTIONS)
    links = spark.createDataFrame([(1, 1, i, "S", "A") for i in range(20)], schemas.LINKS)
    writers.save_metadata_bucketed(questions, links, database="meta", buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = asked_questions(spark.table("meta.questions"), spark.table("meta.question_mps"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop database meta cascade")


@pytest.mark.parametrize("with_cells", [False, True])
def test_questions_to_answers(spark, tmp_path, with_cells):
    from corpusqa.operators.approximate import IvfIndex, train_centroids
    from corpusqa.operators.profiles import member_profiles, ministry_profiles, overlap_profiles

    chunks = corpus_to_chunks(corpus(spark, range(9)), size=20, overlap=4)
    vectors = embedding.embed(chunks, MODEL)
    centroids = train_centroids(vectors, 3) if with_cells else None
    collection = ingest.index_step(chunks, vectors, f"{tmp_path}/collection", centroids=centroids)
    source = IvfIndex(collection, centroids) if with_cells else collection
    requests = spark.createDataFrame(
        [(1, "document 4 speaks", "Shri 1", None), (2, "document", None, "M"), (3, "document", "Nobody", None)],
        "query_id int, query string, mp string, ministry string")
    aliases = spark.createDataFrame([("Shri 1", ["Member 1", "Shri 1"])], schemas.ALIASES)
    questions = spark.createDataFrame([(17, 1, 1, "S", "2020-01-01", "M", "sub")], schemas.QUESTIONS)
    asked = asked_questions(questions, spark.createDataFrame([(17, 1, 1, "S", "Shri 1")], schemas.LINKS))
    answers = {r["query_id"]: r for r in ask.ask(
        requests, source, MODEL, aliases=aliases, nprobe=3,
        profiles=(member_profiles(asked), ministry_profiles(questions, asked), overlap_profiles(asked))).collect()}
    assert {s["qa_id"] for s in answers[1]["sources"]} <= {"1", "4", "7"} and len(answers[1]["sources"]) == 4
    assert "MP Name: Shri 1" in answers[1]["prompt"] and "Ministry: M" in answers[2]["prompt"]
    assert answers[3]["sources"] is None and "STATISTICS" not in answers[3]["prompt"]


def test_steps_count_what_they_do(spark, tmp_path):
    """Two runs: the second skips what the first has done; copies of an id count as skipped."""
    made = []
    for ids in (range(4), range(7)):
        chunks = corpus_to_chunks(corpus(spark, ids), size=80, overlap=10)
        chunks = chunks.unionByName(chunks.where("qa_id = '0'"))
        embedded, indexed = ingest.Counts(), ingest.Counts()
        vectors = ingest.embed_step(chunks, str(tmp_path / "v"), MODEL, counts=embedded)
        ingest.index_step(chunks, vectors, str(tmp_path / "c"), counts=indexed)
        made.append((chunks.count(), chunks.select("chunk_id").distinct().count(), dict(embedded), dict(indexed)))
    (total, new, *one), (more, all_ids, *two) = made
    assert one == [{"total": total, "new": new, "skipped": total - new}] * 2
    assert two == [{"total": more, "new": all_ids - new, "skipped": more - all_ids + new}] * 2


def test_steps_over_nothing(spark, tmp_path):
    chunks = corpus_to_chunks(corpus(spark, []))
    counts = ingest.Counts()
    vectors = ingest.embed_step(chunks, str(tmp_path / "v"), MODEL, counts=counts)
    assert ingest.index_step(chunks, vectors, str(tmp_path / "c")).count() == 0
    assert counts == {"total": 0, "new": 0, "skipped": 0}


def test_stream_reads_no_earlier_batch_and_counts(spark, tmp_path, monkeypatch):
    """Many batches: ids come from keyed state, kept on disk as on a cluster; repeats of a document are skipped."""
    monkeypatch.setattr(streaming, "read_or_empty", lambda *_: pytest.fail("a batch read the stored ids"))
    source, target, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    provider = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(provider)
    spark.conf.set(provider, CLUSTER_CONF[provider])
    seen, batches = [], []
    try:
        for ids in ([0, 1], [1, 2, 3]):
            for i in ids:
                # Document 1 comes in both runs, and twice in a file.
                corpus(spark, [i, i, 9]).coalesce(1).write.mode("append").parquet(source)
            counts = streaming.StreamCounts()
            query = streaming.ingest_stream(
                spark, source, schemas.CORPUS, target, checkpoint, MODEL, files_per_batch=1, counts=counts, size=20, overlap=4)
            query.awaitTermination()
            seen.append(counts.total())
            batches += counts.batches
            spark.streams.removeListener(counts)
    finally:
        spark.conf.set(provider, old)
    size = {i: corpus_to_chunks(corpus(spark, [i]), size=20, overlap=4).count() for i in (0, 1, 2, 3, 9)}
    given = [sum(2 * size[i] + size[9] for i in ids) for ids in ([0, 1], [1, 2, 3])]
    new = [size[0] + size[1] + size[9], size[2] + size[3]]
    assert seen == [{"total": t, "new": n, "skipped": t - n} for t, n in zip(given, new)]
    assert len(batches) == 5 and len({b["batch_id"] for b in batches}) == 5
    stored = streaming.read_collection(spark, target)
    assert stored.count() == sum(new) == stored.select("chunk_id").distinct().count()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_bucketed_steps_shuffle_no_text_and_no_vector(spark, tmp_path):
    bucketed.create_tables(spark, "ingest_test", buckets=4, location=str(tmp_path))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = []
        for ids in (range(4), range(2, 7), range(7)):
            # A third of the rows and more repeat one document.
            docs = corpus(spark, [*ids, *[ids[0]] * len(ids)])
            counts = [ingest.Counts() for _ in range(3)]
            bucketed.add_chunks(docs, "ingest_test", counts=counts[0], size=20, overlap=4)
            assert exchanges(bucketed.pending_texts(spark, "ingest_test", ingest.Counts())) == 0
            bucketed.embed_pending(spark, "ingest_test", MODEL, counts=counts[1])
            assert exchanges(bucketed.left_to_index(spark, "ingest_test", ingest.Counts())) == 0
            bucketed.index_pending(spark, "ingest_test", counts=counts[2])
            done.append([c["new"] for c in counts])
        whole = corpus_to_chunks(corpus(spark, range(7)), size=20, overlap=4)
        first = corpus_to_chunks(corpus(spark, range(4)), size=20, overlap=4).count()
        assert done == [[first] * 3, [whole.count() - first] * 3, [0] * 3]
        stored = spark.table("ingest_test_collection")
        assert sorted(map(tuple, stored.select(*whole.columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
        vectors = {r[0]: r[1] for r in embedding.embed(whole, MODEL).collect()}
        assert {r["chunk_id"]: r["embedding"] for r in stored.collect()} == vectors
        assert bucketed.add_chunks(corpus(spark, []), "ingest_test").count() == whole.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for table in bucketed.TABLES:
            spark.sql(f"drop table if exists ingest_test_{table}")


def test_copies_are_thinned_before_a_shuffle(spark):
    rows = [("a", 1)] * 500 + [(None, 2)] * 300 + [("b", 3)]
    thin = inc.thin_copies(spark.createDataFrame(rows, "chunk_id string, n int").coalesce(1))
    assert sorted(map(tuple, thin.collect()), key=str) == [("a", 1), ("b", 3), (None, 2)]
    assert inc.thin_copies(spark.createDataFrame([], "chunk_id string, n int")).count() == 0
