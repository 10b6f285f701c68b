"""Mixing, sharding and the pipeline against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from corpusqa.llm import decontaminate, minhash, mixing, sharding, simhash, toxicity

SF_DIR = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(epochs * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] >= epochs * sizes[s]}
        if not over:
            return {**target, **{s: float(epochs * sizes[s]) for s in capped}}
        capped |= over
        if len(capped) == len(order):
            return {s: float(epochs * sizes[s]) for s in order}


def test_mix_on_edges(edge_docs, edge_rows, no_docs):
    rows = mixing.mix_table(edge_docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in edge_rows:
        sizes[r[3]] += count(r[1])
    want = brute_targets(sizes)
    assert len(rows) == len(edge_rows)
    assert sorted(r.size for r in rows) == sorted(count(r[1]) for r in edge_rows)
    assert Counter((r.source_size, round(r.target, 6)) for r in rows) == Counter((sizes[r[3]], round(want[r[3]], 6)) for r in edge_rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_table(edge_docs.repartition(7)).collect()))
    assert mixing.mix_table(no_docs).count() == 0
    mixed = mixing.mix_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert sum(count(r.text) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix_documents(no_docs).count() == 0


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, "d": 7000}, {"a": 0, "b": 0}, {"x": 10}, {None: 5, "é": 50, "z": 500, "Z": 1},
])
def test_targets_equal_water_filling_by_hand(spark, sizes):
    stored = mixing.write_and_read(spark.createDataFrame(list(sizes.items()), "source string, size long"), "t")
    got = {r.source: r.target for r in mixing.source_targets(stored).collect()}
    want = brute_targets(sizes)
    assert got == pytest.approx(want)
    if sum(sizes.values()):
        assert sum(got.values()) == pytest.approx(min(1.5, 2) * sum(sizes.values()))


def test_taken_words_come_near_the_target(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i * 37 % 90), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix_table(docs).collect()
    by_target = defaultdict(list)
    for r in rows:
        by_target[r.source_size, r.target].append(r)
    for (_, target), group in by_target.items():
        assert abs(sum(r.taken for r in group) - target) <= max(r.size for r in group)
    assert any(0 < sum(r.taken == 2 * r.size for r in g) < len(g) for g in by_target.values())


def test_shards_on_edges(edge_docs, edge_rows, no_docs):
    rows = sharding.shard_table(edge_docs).collect()
    plain = [(r[0], (r[1] or "").encode()) for r in edge_rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((k, len(t) + 1, zlib.crc32(t)) for k, t in plain)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in rows:
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
        slots[r.shard].append(r.slot)
        shards[r.doc_id].add((r.shard, r.grown_shard))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    assert sharding.shard_table(no_docs).count() == 0


def test_shards_follow_weights_and_growth(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "doc_id")
    even = sharding.assign_shards(keys, shards=16)
    counts = {r.shard: r["count"] for r in even.groupBy("shard").count().collect()}
    assert len(counts) == 16 and max(counts.values()) < 1.15 * 2500 and min(counts.values()) > 0.85 * 2500
    moved = even.where("shard <> grown_shard")
    assert moved.where("grown_shard <> 16").count() == 0
    assert moved.count() == pytest.approx(40_000 / 17, rel=0.1)
    # The grown assignment is what 17 shards give.
    seventeen = sharding.assign_shards(keys, shards=17).selectExpr("doc_id", "shard s17")
    assert even.join(seventeen, "doc_id").where("grown_shard <> s17").isEmpty()
    heavy = sharding.assign_shards(keys, shards=4, weights={2: 3.0}).groupBy("shard").count().collect()
    assert {r.shard: r["count"] for r in heavy}[2] == pytest.approx(20_000, rel=0.05)


def test_written_shards_read_back(spark, edge_docs, tmp_path):
    sharding.write_shards(edge_docs.drop("shard"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == edge_docs.count()
    want = {(r.doc_id, r.shard) for r in sharding.assign_shards(edge_docs).collect()}
    assert {(r.doc_id, r.shard) for r in back.collect()} == want


def test_seeded_numbers_are_md5(spark):
    got = spark.createDataFrame([(5,), (None,)], "k long").select(mixing.seeded_number(mixing.F.col("k"))).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(k + b":11").hexdigest()[:15], 16) for k in (b"5", b"null")]
    assert all(math.log2(r[0] + 1) <= 60 for r in got)


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = mixing.write_and_read(stage(spark, docs, SF_DIR), name)
        seen[name] = docs.count()
        if name != "sharding":
            assert docs.columns == columns
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert docs.count() <= before.count()
            assert docs.exceptAll(before).isEmpty()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert docs.columns[-2:] == ["shard", "grown_shard"] and seen["sharding"] == seen["mixing"]
    assert sorted(docs.collect()) == sorted(corpus_pipeline.run(spark, SF_DIR).collect())


def test_stages_agree_with_the_tables_of_their_operators(spark):
    """Each stage keeps what its operator's table says, computed anew from the stage's own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tables = {
        "toxicity": lambda d: {r.doc_id for r in toxicity.toxicity_table(d, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect() if not r.predicted},
        "near_duplicates": lambda d: {r.component_id for r in simhash.near_duplicate_table(d).collect()},
        "decontamination": lambda d: {r.doc_id for r in d.collect()} - {
            r.doc_id for r in decontaminate.leaks(d, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()},
    }
    for name, stage in corpus_pipeline.STAGES[:3]:
        want = tables[name](docs)
        docs = mixing.write_and_read(stage(spark, docs, SF_DIR), name)
        assert {r.doc_id for r in docs.collect()} == want, name
    mixed = Counter(r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, docs, SF_DIR).collect())
    want = {r.doc_id: r.taken // r.size for r in mixing.mix_table(docs).collect() if r.size}
    assert mixed == Counter({k: n for k, n in want.items() if n})


def test_columns_with_any_name_are_kept(spark):
    names = ["doc_id", "text", "source", "_source", "_row", "_print", "_toxicity", "_number", "_copy", "a b"]
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 5, "s", 1, 2, 3, 4, 5, 6, 7) for i in range(5)], names)
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    for kept in (mixing.mix_documents(docs), simhash.keep_one(docs), minhash.keep_one(docs), toxicity.drop_toxic(docs, labels)):
        assert kept.columns == names
        assert {tuple(r)[3:] for r in kept.collect()} <= {(1, 2, 3, 4, 5, 6, 7)}


def test_pipeline_on_edges(spark, edge_docs, no_docs):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (edge_docs.select(*plain), no_docs.select(*plain)):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
        assert docs.columns == [*plain, "shard", "grown_shard"]
        docs.collect()
