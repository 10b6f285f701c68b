"""Search against brute force on small collections."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusqa.functions.batches import parts
from corpusqa.operators import approximate as ann
from corpusqa.operators import dense, embedding, hybrid, lexical, paired, topk
from corpusqa.session import scratch_path

CHUNK = "chunk_id string, embedding array<float>, members string, ministry string, text string"
WORDS = ["road", "rail", "health", "water", "school", "tax", "army", "farm", "the", "of"]


@pytest.fixture(scope="module")
def data(spark):
    """A third of the chunks are copies of one chunk."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        if i % 3 == 0:
            vector, text = [0.5, 0.5, 0.5, 0.5], "the rail of the road"
        else:
            vector = [rng.gauss(0, 1) for _ in range(4)]
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30)))
        rows.append((f"c{i:03d}", vector, f"Member {i % 7}, Member {i % 20}", f"src{i % 4}", text))
    return rows, spark.createDataFrame(rows, CHUNK).repartition(6).cache()


def allowed(row, names, ministry):
    return (not names or any(n in row[2] for n in names)) and (not ministry or row[3] == ministry)


def best(scores, k):
    return [(c, s) for s, c in sorted(((-s, c) for c, s in scores.items()))[:k] for s in [-s]]


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 6)))
    return out


QUERIES = [
    (1, [1.0, 0.0, 0.0, 0.0], None, None), (2, [0.5, 0.5, 0.5, 0.5], None, "src1"), (3, [0.0, 1.0, -1.0, 0.0], ["Member 3"], None),
    (4, [0.0, 0.0, 1.0, 0.0], ["Member 1", "Member 5"], "src2"), (5, [1.0, 1.0, 1.0, 1.0], ["Nobody"], None),
]


def dense_truth(rows, k):
    out = {}
    for q, v, names, ministry in QUERIES:
        scores = {r[0]: round(float(np.dot(v, np.float32(r[1]).astype(float))), 9) for r in rows if allowed(r, names, ministry)}
        if scores:
            out[q] = [(c, round(s, 6)) for c, s in best(scores, k)]
    return out


def query_frame(spark):
    return spark.createDataFrame(QUERIES, "query_id int, embedding array<float>, names array<string>, ministry string")


@pytest.mark.parametrize("block", [1024, 2])
def test_dense_equals_brute_force(spark, data, block):
    rows, chunks = data
    assert by_query(dense.dense_topk(chunks, query_frame(spark), 10, block=block)) == dense_truth(rows, 10)


def test_dense_rejects_vectors_of_another_length(spark, data):
    _, chunks = data
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, embedding array<float>")
    with pytest.raises(Exception, match="every vector must have length 2"):
        dense.dense_topk(chunks, queries).collect()


def test_ties_of_copies_go_to_the_smallest_ids(spark, data):
    _, chunks = data
    queries = spark.createDataFrame([("q", [0.5, 0.5, 0.5, 0.5])], "query_id string, embedding array<float>")
    copies = chunks.where("text = 'the rail of the road'")
    assert [c for c, _ in by_query(dense.dense_topk(copies, queries, 5))["q"]] == ["c000", "c003", "c006", "c009", "c012"]


def test_recall_rises_to_exact_with_the_cells_probed(spark, data):
    rows, chunks = data
    index = ann.write_ivf(ann.build_ivf(chunks, 8), scratch_path(spark, "test-ivf"))
    assert index.collection.count() == len(rows)
    truth = dense_truth(rows, 10)
    recalls = []
    for nprobe in (1, 4, 8):
        got = by_query(ann.ivf_topk(index, query_frame(spark), 10, nprobe=nprobe))
        recalls.append(sum(len(set(got.get(q, [])) & set(t)) for q, t in truth.items()))
        if nprobe == 8:
            assert got == truth
    assert recalls == sorted(recalls) and recalls[0] > 0


def test_a_probe_reads_only_its_cells(spark, data):
    _, chunks = data
    index = ann.write_ivf(ann.build_ivf(chunks, 8), scratch_path(spark, "test-ivf"))
    query = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id int, embedding array<float>")
    probing = ann.nearest_cells(query, index.centroids, 1)
    found = dense.dense_topk(index.collection, probing, 5, cell_col="cell", probes_col="cells")
    assert "PartitionFilters: [isnotnull(cell" in found._jdf.queryExecution().executedPlan().toString()


def bm25_truth(rows, queries, k):
    docs = {r[0]: Counter(re.findall(r"[^\W_]+", r[4].lower())) for r in rows}
    n, avgdl = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = Counter(t for d in docs.values() for t in d)
    out = {}
    for q, text, names, ministry in queries:
        scores = {}
        for r in rows:
            d = docs[r[0]]
            hit = [t for t in set(re.findall(r"[^\W_]+", text.lower())) if d[t]]
            if hit and allowed(r, names, ministry):
                scores[r[0]] = round(sum(
                    math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * d[t] * 2.2
                    / (d[t] + 1.2 * (0.25 + 0.75 * sum(d.values()) / avgdl)) for t in hit), 9)
        if scores:
            out[q] = [(c, round(s, 6)) for c, s in best(scores, k)]
    return out


TEXTS = [
    (1, "The ROAD to health", None, None), (2, "rail rail rail", ["Member 3"], None), (3, "unknown words", None, None),
    (4, "tax of the army", ["Member 1", "Member 2"], "src1"), (5, "", None, None), (6, "farm water school", None, "src3"),
]


@pytest.mark.parametrize("block", [1024, 2])
@pytest.mark.parametrize("stored", [None, "documents", "postings"])
def test_bm25_equals_brute_force(spark, data, block, stored):
    rows, chunks = data
    source = lexical.bm25_scan(chunks)
    if stored:
        path = scratch_path(spark, "test-bm25")
        lexical.bm25_index(chunks).write(path)
        source = lexical.read_bm25_index(spark, path, gathered_share=100 if stored == "postings" else 0)
    queries = spark.createDataFrame(TEXTS, "query_id int, query string, names array<string>, ministry string")
    assert by_query(lexical.bm25_topk(source, queries, 10, block=block)) == bm25_truth(rows, TEXTS, 10)


def test_small_score_parts_give_the_same_result(spark, data, monkeypatch):
    rows, chunks = data
    monkeypatch.setattr(lexical, "SCORE_CELLS", 20)
    queries = spark.createDataFrame(TEXTS, "query_id int, query string, names array<string>, ministry string")
    assert by_query(lexical.bm25_topk(lexical.bm25_scan(chunks), queries, 10)) == bm25_truth(rows, TEXTS, 10)


def test_fusion_sums_reciprocal_ranks(spark):
    schema = "query_id int, chunk_id string, rank int"
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], schema)
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], schema)
    got = by_query(hybrid.reciprocal_rank_fusion([a, b], 2))
    assert got == {1: [("y", round(1 / 61 + 1 / 62, 6)), ("x", round(1 / 61, 6))]}


def test_attach_keeps_every_winner(spark, data):
    _, chunks = data
    top = dense.dense_topk(chunks, query_frame(spark), 3)
    for bound in (None, 15):
        out = topk.attach_chunks(top, chunks.drop("embedding"), bound=bound)
        assert out.count() == top.count() and "text" in out.columns
    # A second row under an id does not multiply the winners.
    twice = chunks.drop("embedding").unionByName(chunks.drop("embedding"))
    assert topk.attach_chunks(top, twice, bound=15).count() == top.count()


def test_copies_without_an_id_stay_apart_from_other_texts(spark):
    from corpusqa.operators.chunking import chunk_documents

    df = spark.createDataFrame([("", "One text."), ("", "One text."), ("", "Another text.")], "qa_id string, text string")
    ids = [r["chunk_id"] for r in chunk_documents(df).collect()]
    assert len(ids) == 3 and len(set(ids)) == 2


def test_embedding_runs_in_batches_and_normalises(spark):
    texts = [(f"c{i}", f"word{i} word") for i in range(25)] + [("empty", ""), ("null", None)]
    df = spark.createDataFrame(texts, "chunk_id string, text string").repartition(3)

    def factory():
        model = embedding.hashing_model(16)()

        def checked(batch):
            assert len(batch) <= 4 and all(t.startswith("passage: ") for t in batch)
            return model(batch)

        return checked

    rows = {r["chunk_id"]: r["embedding"] for r in embedding.embed(df, factory, batch_size=4).collect()}
    assert len(rows) == 26
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in rows.values())
    zero = embedding.embed(df.where("chunk_id = 'empty'"), lambda: (lambda t: np.zeros((len(t), 3)))).first()
    assert zero["embedding"] == [0.0, 0.0, 0.0]


def test_queries_use_the_query_prefix(spark):
    queries = spark.createDataFrame([(1, "rail")], "query_id int, query string")
    seen = embedding.embed_queries(queries, lambda: (lambda t: [[float(x == "query: rail"), 0.0] for x in t])).first()
    assert seen["embedding"] == [1.0, 0.0]


def test_collection_is_scanned_by_needed_columns_only(spark, data):
    _, chunks = data
    path = scratch_path(spark, "test-scan")
    chunks.write.parquet(path)
    plan = dense.dense_topk(spark.read.parquet(path), query_frame(spark).drop("names"))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "WindowGroupLimit" in text and "Cartesian" not in text and "NestedLoop" not in text
    assert "text" not in text.split("ReadSchema: ")[1].split("\n")[0]
    only = query_frame(spark).where(F.col("ministry").isNotNull())
    filtered = dense.dense_topk(spark.read.parquet(path), only)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in filtered and "In(ministry, [src1,src2])" in filtered


def test_cells_that_hold_too_little_are_widened(spark, data):
    rows, chunks = data
    index = ann.write_ivf(ann.build_ivf(chunks, 8), scratch_path(spark, "test-ivf"))
    got = by_query(ann.ivf_topk(index, query_frame(spark), 10, nprobe=1))
    matching = {q: sum(allowed(r, names, ministry) for r in rows) for q, _, names, ministry in QUERIES}
    assert {q: len(got.get(q, [])) for q in matching} == {q: min(n, 10) for q, n in matching.items()}


def test_every_vector_counts_in_the_centroids(spark):
    rows = [("a", [0.0, 0.0])] * 900 + [("b", [10.0, 10.0])] * 90 + [("n", [float("nan"), 1.0]), ("z", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    local = chunks.where("embedding is not null").select("embedding").mapInArrow(ann._summaries(1), "embedding array<double>, weight double")
    assert local.agg(F.sum("weight")).first()[0] == 990
    centres = sorted(r["embedding"] for r in ann.train_centroids(chunks, 2).collect())
    assert centres == [[0.0, 0.0], [10.0, 10.0]]


def test_vectors_that_are_not_numbers_hide_no_others(spark):
    rows = [(f"c{i}", [float(i), 1.0]) for i in range(5)] + [("bad", [float("nan"), 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert by_query(dense.dense_topk(chunks, queries, 3))[1] == [("c4", 4.0), ("c3", 3.0), ("c2", 2.0)]


def test_chunks_without_text_count_alike_in_both_forms(spark):
    rows = [("a", "rail road"), ("b", None), ("c", "rail"), ("d", "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "rail"), (2, None)], "query_id int, query string")
    stored = lexical.bm25_index(chunks).write(scratch_path(spark, "test-bm25"))
    assert by_query(lexical.bm25_topk(stored, queries)) == by_query(lexical.bm25_topk(lexical.bm25_scan(chunks), queries))


def test_repeated_query_ids_are_all_read_once(spark, data):
    _, chunks = data
    seen = []
    queries = spark.range(50).selectExpr("cast(id % 3 as int) query_id", "id n").repartition(4)

    def search(rows):
        seen.append(sorted(r["n"] for r in rows))
        return spark.createDataFrame([(r["n"],) for r in rows], "n long")

    assert sorted(r["n"] for r in topk.in_blocks(queries, 7, search).collect()) == list(range(50))
    assert all(len(block) <= 7 for block in seen) and len(seen) == 8


def test_queries_keep_their_vectors_whatever_their_ids(spark):
    """Repeated and null ids, null texts, and columns beside them."""
    queries = spark.createDataFrame(
        [(1, "a", ["x"]), (1, "bb", None), (None, "ccc", []), (None, None, ["y"]), (1 << 60, "dddd", None)],
        "query_id long, query string, names array<string>")
    made = embedding.embed_queries(queries, lambda: (lambda texts: [[float(len(t)), 0.0] for t in texts]), normalize=False)
    got = sorted((tuple(r) for r in made.select("query_id", "query", "names", "embedding").collect()), key=repr)
    size = len("query: ")
    assert got == sorted([
        (1, "a", ["x"], [size + 1.0, 0.0]), (1, "bb", None, [size + 2.0, 0.0]), (None, "ccc", [], [size + 3.0, 0.0]),
        (None, None, ["y"], None), (1 << 60, "dddd", None, [size + 4.0, 0.0])], key=repr)


def test_many_queries_run_in_a_constant_number_of_jobs(spark, data):
    """Beyond one block, queries are a table: more of them are no more jobs, and results stay those of one block."""
    rows, chunks = data
    rng = random.Random(3)
    jobs = []
    for n in (40, 400):
        queries = spark.createDataFrame(
            [(i, [rng.gauss(0, 1) for _ in range(4)], ["Member 3"] if i % 5 == 0 else None, f"src{i % 4}" if i % 3 == 0 else None) for i in range(n)],
            "query_id int, embedding array<float>, names array<string>, ministry string").repartition(3)
        spark.sparkContext.setJobGroup(f"many-{n}", "")
        got = by_query(dense.dense_topk(chunks, queries, 7, block=16))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"many-{n}")))
        assert got == by_query(dense.dense_topk(chunks, queries, 7, block=10_000))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0]


def clustered(spark):
    """Vectors around a hundred centres, as texts of common subjects have them."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(100, 32))
    points = centres[rng.integers(0, 100, 3000)] + 0.3 * rng.normal(size=(3000, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "chunk_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("given,nprobe", [(False, 8), (True, 32)])
def test_cell_join_equals_blocks_and_recalls(spark, given, nprobe):
    """Every twentieth vector against all, 64 cells: joined by cell as in one block, and near the exact lists.

    The given vectors point in all directions alike, which cells serve worst.
    """
    vectors = clustered(spark)
    if given:
        vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id chunk_id", "embedding")
    index = ann.write_ivf(ann.build_ivf(vectors, 64), scratch_path(spark, "test-ivf"))
    queries = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    probing = ann.nearest_cells(queries, index.centroids, nprobe)
    by_cells = [by_query(dense.dense_topk(index.collection, probing, 10, block=b, cell_col="cell", probes_col="cells")) for b in (16, 10_000)]
    assert by_cells[0] == by_cells[1]
    exact = by_query(dense.dense_topk(vectors, queries, 10))
    found = by_query(ann.ivf_topk(index, queries, 10, nprobe=nprobe, block=16))
    hits = [len({c for c, _ in found[q]} & {c for c, _ in exact[q]}) / len(exact[q]) for q in exact]
    assert np.mean(hits) >= 0.9


def test_few_vectors_make_few_cells(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(40)] + [(99, [float("nan"), 1.0])], "chunk_id int, embedding array<float>")
    assert 1 <= ann.train_centroids(vectors, 16).count() <= 3


def test_one_request_equals_a_batch(spark, data):
    rows, chunks = data
    for q, vector, names, ministry in QUERIES:
        got = dense.nearest_chunks(chunks, vector, 10, names=names or (), ministry=ministry).orderBy("rank").collect()
        assert [(r.chunk_id, round(r.score, 6)) for r in got] == dense_truth(rows, 10).get(q, [])
        assert all(r.text is not None and r.rank == i + 1 for i, r in enumerate(got))


def test_one_request_is_few_jobs(spark, data):
    from corpusqa.plans.retrieve import retrieve, retrieve_one

    _, chunks = data
    model = embedding.hashing_model(4)
    texts = chunks.drop("embedding")
    stored = scratch_path(spark, "test-one")
    embedding.embed(texts, model, keep=texts.columns).write.parquet(stored)
    collection = spark.read.parquet(stored)
    spark.sparkContext.setJobGroup("one", "")
    found = [r.chunk_id for r in retrieve_one("rail and road", collection, model, k=5, ministry="src1").collect()]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one")) <= 3
    spark.sparkContext.setJobGroup("", "")
    batch = spark.createDataFrame([(1, "rail and road", "src1")], "query_id int, query string, ministry string")
    assert found == [r.chunk_id for r in retrieve(batch, collection, model, k=5).orderBy("rank").collect()]


def test_many_queries_stay_off_the_driver(spark):
    """Stored queries look small; the copies of them that meet the collection are not."""
    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 9)]) for i in range(300)]
    points = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    found = dense.dense_topk(points, points.withColumnRenamed("chunk_id", "query_id"), 5, block=20)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    vectors = np.array([v for _, v in rows])
    scores = vectors @ vectors.T
    want = {(q, c) for q in range(300) for c in sorted(range(300), key=lambda c: (-scores[q, c], c))[:5]}
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == want


def test_terms_are_scored_in_parts_of_bounded_size():
    words = [f"w{i}" for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array([words] * 6_000)], names=["terms"])
    data = {"terms": words, "idf": np.ones(100), "avgdl": 100.0, "queries": 100, "starts": np.arange(101), "users": np.arange(100)}
    tracemalloc.start()
    seen = sum(len(index) for part in parts(batch, "terms", lexical.TERMS) for _, index, _ in lexical._bm25(data, part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 6_000 and peak < 50 << 20


def test_parts_of_a_batch():
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["a" * 9, None, "b", "c" * 50, "d"]), pa.array([[1], None, [], [2, 3, 4], [5]])], names=["text", "list"])
    assert [p.num_rows for p in parts(batch, "text", 10)] == [3, 1, 1]
    assert [p.num_rows for p in parts(batch, "list", 2)] == [3, 1, 1]
    assert [p.num_rows for p in parts(batch.slice(3), "text", 10)] == [1, 1]
    assert not list(parts(batch.slice(0, 0), "text", 10))


def test_names_are_looked_up_together():
    """All names at once find what one search after another finds."""
    rng = np.random.default_rng(3)
    letters = list("abé漢, ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(200)]
    names = ["", "a", "é漢", "abab", *{"".join(rng.choice(letters, rng.integers(1, 5))) for _ in range(80)}]
    names = list(dict.fromkeys(names))
    found = topk.NameIndex(names).hits(pa.array(texts))
    assert found == sorted((n, t) for n, name in enumerate(names) for t, text in enumerate(texts) if name in text)
    assert topk.NameIndex([]).hits(pa.array(texts)) == [] and topk.NameIndex(names).hits(pa.array([], pa.string())) == []


def test_a_grid_scores_only_rows_that_pass_the_filters(spark):
    rng = np.random.default_rng(5)
    chunks = spark.createDataFrame(
        [(f"c{i}", rng.normal(size=4).tolist(), None if i % 9 == 0 else f"Member {i % 13}, Member {i % 5}", None if i % 7 == 0 else f"m{i % 3}")
         for i in range(300)], "chunk_id string, embedding array<float>, members string, ministry string")
    queries = spark.createDataFrame(
        [(i, rng.normal(size=4).tolist(), [None, [], [f"Member {i % 15}"], [f"Member {i % 13}", "ember 4", ""][: i % 3 + 1], ["nobody"]][i % 5],
          [None, "m1", "", "m2", "none"][i // 5 % 5]) for i in range(60)],
        "query_id int, embedding array<float>, names array<string>, ministry string")

    def rows(found):
        return sorted((r.query_id, r["rank"], r.chunk_id) for r in found.collect())

    assert rows(dense.dense_topk(chunks, queries, 5, block=7)) == rows(dense.dense_topk(chunks, queries, 5))

    def score(data, batch):
        raise ValueError("scored")

    asked = queries.select("query_id", "embedding", F.array(F.lit("nobody")).alias("names"), "ministry")
    assert paired.paired_topk(chunks, asked, 5, score, block=7).count() == 0
