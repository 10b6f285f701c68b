"""MinHash groups against brute force on full sets."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusqa.llm import minhash, queries
from corpusqa.llm.components import components

SF_DIR = "/root/testdata/sf0.001"


def brute_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_groups(rows, size=4, percent=80):
    """(key, size of the set, component) of each (key, text)."""
    sets = [brute_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def table(rows, size=4, percent=80):
    return Counter((k, n, c) for k, n, c in brute_groups(rows, size, percent))


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_minhash_groups"](spark, SF_DIR)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(got) == table(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_edges(edge_docs, edge_rows, no_docs):
    assert result(minhash.near_duplicate_table(edge_docs)) == table([(r[0], r[1]) for r in edge_rows])
    assert minhash.near_duplicate_table(no_docs).count() == 0
    kept = minhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    groups = brute_groups([(r[0], r[1]) for r in edge_rows], 5)
    # One row of each group that has words, by its smallest key where it has one, and all rows without words.
    with_words = {c if c is not None else "none" for k, n, c in groups if n}
    keys = Counter(r.doc_id for r in kept.collect())
    assert keys.total() == len(with_words) + sum(1 for _, n, _ in groups if not n)
    assert keys[7] == 1 and keys[8] == 0 and keys[10] == 0 and keys[None] == 1
    assert minhash.keep_one(no_docs).count() == 0


def varied(rng, words, changes):
    """The text with some of its words replaced."""
    out = list(words)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"z{rng.integers(1 << 40)}"
    return out


@pytest.fixture(scope="module")
def families():
    """Chains of near copies, copies of one centre, families that share half a text, short texts, exact copies."""
    rng = np.random.default_rng(5)
    base = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
    texts = []
    for _ in range(6):  # a chain: ends of it are different texts
        step = base(200)
        for _ in range(12):
            step = varied(rng, step, 4)
            texts.append(" ".join(step))
    centre = base(300)
    texts += [" ".join(varied(rng, centre, int(rng.integers(1, 12)))) for _ in range(120)]
    shared = base(150)
    for _ in range(60):  # alike by about a third to two thirds, and near copies within
        mine = shared + base(int(rng.integers(20, 160)))
        texts.append(" ".join(mine))
        texts.append(" ".join(varied(rng, mine, int(rng.integers(1, 6)))))
    for n in range(1, 9):  # sets of one to five runs
        short = base(n)
        texts += [" ".join(short), " ".join(short + ["more"]), " ".join(short).upper(), " ".join(short[::-1])]
    texts += ["the same text three hundred times over and over again"] * 300
    order = rng.permutation(len(texts))
    return [(int(i), texts[i]) for i in order]


@pytest.mark.parametrize("block", [512, 8])
def test_families_equal_brute_force(spark, families, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(3)
    want = table(families)
    assert result(minhash.near_duplicate_table(docs)) == want
    # Some component needs links that a star doesn't hold.
    assert max(Counter(c for _, _, c in want).values()) < len(families)


@pytest.mark.parametrize("percent,size", [(60, 3), (95, 5)])
def test_other_similarities(spark, families, percent, size):
    rows = families[:250]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.near_duplicates(docs, shingle=size, percent=percent)) == table(rows, size, percent)


def test_a_third_of_all_rows_in_one_group(spark):
    """Copies and near copies of one text: each is compared once, in groups of bounded size."""
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base) if i % 2 else " ".join(base[:70] + [f"x{i}"] + base[71:])) for i in range(2000)]
    rows += [(2000 + i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicate_table(docs).collect()}
    assert all(got[i] == 0 for i in range(2000)) and all(got[i] == i for i in range(2000, 2200))


def test_bins_estimate_similarity():
    """Densified bins agree as often as the sets, for small sets and large."""
    rng = np.random.default_rng(1)
    for n in (2, 5, 20, 100, 3000):
        shared = int(round(n * 0.8))
        agree = []
        for _ in range(200):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.r_[a[:shared], rng.integers(0, 1 << 63, n - shared).astype(np.uint64)]
            pair = minhash.bins_of(np.r_[np.sort(a), np.sort(b)], np.array([0, n, 2 * n]))
            assert not (pair == minhash._EMPTY).any()
            agree.append((pair[0] == pair[1]).mean())
        assert np.mean(agree) == pytest.approx(shared / (2 * n - shared), abs=0.03)


def test_shingles_keep_order_and_length():
    texts = ["a b c d", "d c b a", "a b", "a", "a b c", "ab c d", "A\tB\x0bc  d", None, "", " \n", "a b c d a b c d"]
    values, bounds = minhash.shingle_sets(pa.array(texts, pa.string()), 4)
    sets = [tuple(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    assert sets[0] == sets[6] and len({s for s in sets if s}) == 7
    assert [len(s) for s in sets] == [1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 4]


def brute_roots(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {frozenset(x for x in root if find(x) == r) for r in {find(x) for x in root}}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_of_any_shape(spark, shape, monkeypatch):
    from corpusqa.llm import components as module

    rng = np.random.default_rng(2)
    pairs = {
        "chain": [(i, i + 1) for i in range(1000)], "star": [(0, i) for i in range(1, 400)],
        "random": [tuple(map(int, p)) for p in rng.integers(0, 500, (420, 2))],
    }[shape]
    rounds = []
    write = module.write_and_read
    monkeypatch.setattr(module, "write_and_read", lambda df, label: (rounds.append(label), write(df, label))[1])
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert {frozenset(g) for g in groups.values()} == {g for g in brute_roots(pairs) if len(g) > 1}
    # A chain of 1,000 in order takes no more rounds than any other.
    assert rounds.count("hooks") <= 14
