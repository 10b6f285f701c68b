"""Block naming and SimHash against brute force."""

import hashlib
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpusqa.llm import exact_dedup, queries, simhash
from corpusqa.session import write_and_read

SF_DIR = "/root/testdata/sf0.001"


def brute_duplicates(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    out = []
    for text, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(k, best, len(keys), digest) for k in keys]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 5, 2048])
def test_exact_duplicates_equal_brute_force(edge_docs, edge_rows, block):
    # Blocks of one byte give as many levels as texts can have.
    rows = [(r[0], r[1] if block > 1 else (r[1] or "")[:300]) for r in edge_rows]
    docs = edge_docs if block > 1 else edge_docs.selectExpr("doc_id", "substr(text, 1, 300) text")
    got = exact_dedup.exact_duplicates(docs, block_bytes=block).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute_duplicates(rows)
    # Exactly one row of each group stays, and it has the group's largest key.
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_duplicates_of_nothing(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_same_blocks_in_other_order_are_different(spark):
    texts = ["aabb", "bbaa", "aabbaa", "aabbaab", "aab", "aa", "aabb" * 9, "aabb" * 9 + "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs, block_bytes=2).collect()
    assert {r.group_size for r in got} == {1}


def brute_fingerprint(text, size=3):
    plain = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in plain).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(keys, prints, most=3):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    p = np.array(prints, dtype=np.uint64)
    for i in range(len(p)):
        for j in np.nonzero(np.bitwise_count(p[i] ^ p[i + 1:]) <= most)[0] + i + 1:
            parent[find(j)] = find(i)
    smallest = {}
    for i, key in enumerate(keys):
        if key is not None:
            smallest[find(i)] = min(key, smallest.get(find(i), key))
    return [smallest.get(find(i)) for i in range(len(p))]


def test_simhash_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r.doc_id for r in rows], prints))}
    assert {tuple(r) for r in queries.QUERIES["op7_simhash_groups"](spark, SF_DIR).collect()} == want


def test_simhash_on_edges(edge_docs, edge_rows, no_docs):
    rows = [(r[0], brute_fingerprint(r[1])) for r in edge_rows]
    want = [(k, f"{p:016x}", c) for (k, p), c in zip(rows, brute_components([k for k, _ in rows], [p for _, p in rows]))]
    got = [tuple(r) for r in simhash.near_duplicate_table(edge_docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicate_table(no_docs).count() == 0


@pytest.mark.parametrize("bucket_rows", [50_000, 200, 30])
def test_components_of_chains_and_balls(spark, bucket_rows):
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(0, 2**63, 200)]
    for start in prints[:30]:
        step = start
        for _ in range(25):  # a chain: each one bit or three from the last
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                step ^= 1 << int(b)
            prints.append(step)
    prints += [prints[50] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12, 40)]
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    stored = write_and_read(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fingerprint long"), "prints")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(stored, bucket_rows=bucket_rows).collect()}
    want = brute_components(range(len(prints)), prints)
    assert [got[i] for i in range(len(prints))] == want


def test_keep_one_leaves_one_row_of_each_component(edge_docs, edge_rows):
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    want = brute_components(range(len(edge_rows)), [brute_fingerprint(r[1]) for r in edge_rows])
    rows = kept.collect()
    assert len(rows) == len(set(want))
    assert sum(r.doc_id == 7 for r in rows) == 1 and sum(r.doc_id == 1 for r in rows) == 1


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_bucket_search_holds_bounded_arrays():
    """A crowded bucket, whose members are near many others, is searched in small steps."""
    prints = np.random.default_rng(3).choice(1 << 18, 30_000, replace=False).astype(np.uint64)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(len(prints), dtype=np.int64)), pa.array(prints.view(np.int64))], names=["bucket", "fingerprint"])
    tracemalloc.start()
    found = list(simhash._bucket_links(3)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20
    # Every fingerprint has others within three bits, all in one component.
    assert sum(b.num_rows for b in found) == len(prints) - 1
