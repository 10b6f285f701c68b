"""Toxicity and quality by held-out accuracy, and on edges."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusqa.llm import queries, toxicity
from corpusqa.llm import quality as q

SF_DIR = "/root/testdata/sf0.01"


def check_table(spark, name, label, folds, fold, threshold):
    rows = queries.QUERIES[name](spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    return [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def test_quality_on_held_out_rows(spark):
    held = check_table(spark, "op5_quality", "quality", 5, 0, q.THRESHOLD)
    assert np.mean([p == t for p, t in held]) > 0.94
    assert np.mean([p for p, t in held if t]) > 0.98


def test_toxicity_on_held_out_rows(spark):
    held = check_table(spark, "op9_toxicity", "toxic", 3, 1, toxicity.THRESHOLD)
    # Some fifty toxic rows to learn from, in four languages.
    assert np.mean([p for p, t in held if t]) > 0.6
    assert np.mean([p for p, t in held if not t]) < 0.03


@pytest.fixture(scope="module")
def edge_labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12)]
    rows += [(7, 0, 1), (None, 1, 1), (2, None, None), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_models_on_edges(spark, edge_docs, edge_labels, no_docs):
    nothing = edge_labels.where("false")
    for table, label in ((q.quality_table, "quality"), (toxicity.toxicity_table, "toxic")):
        rows = table(edge_docs, edge_labels).collect()
        assert len(rows) == edge_docs.count()
        assert all(0 <= r.score <= 1 for r in rows)
        same = {r.score for r in rows if r.doc_id == 7}
        assert len(same) == 1
        assert table(no_docs, edge_labels).count() == 0
        assert {r.score for r in table(edge_docs, nothing).collect()} == {0.5 if label == "quality" else 0.0}
    kept = toxicity.drop_toxic(edge_docs, nothing)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


def test_statistics_equal_brute_force(edge_rows):
    texts = [r[1] for r in edge_rows] + ["Aa!! bb|bb\ncc 12 é", "x x x y"]
    columns = dict(zip(q.STATISTICS, q._statistics(pa.array(texts, type=pa.string()))))
    for i, text in enumerate(texts):
        plain = (text or "").encode()
        for kind, chars in q.KINDS.items():
            assert columns[f"{kind}_share"][i] == pytest.approx(sum(b in chars for b in plain) / max(len(plain), 1))
        assert columns["log_bytes"][i] == pytest.approx(math.log1p(len(plain)))
    assert columns["top_share"][-1] == 0.75 and columns["again_share"][-1] == 0.5 and columns["distinct_share"][-1] == 0.5


def test_scores_read_statistics_alone(spark):
    rows = q.train(
        spark.createDataFrame([(i, *([float(i % 2)] * len(q.STATISTICS))) for i in range(200)], ["doc_id", *q.STATISTICS]),
        spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"))
    used = set(str(rows._jc.toString()).replace("(", " ").replace(")", " ").split())
    assert not used & {"doc_id", "lang", "source", "quality", "label"}


def test_rare_expressions_fall_back(spark):
    """An expression that only toxic rows hold decides, wherever it stands in a long text."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 150))
        if i % 5 == 0:
            for at in rng.choice(150, 3, replace=False):
                text[at] = rng.choice(["foul", "vile"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0)))
    docs.append((9000, " ".join(rng.choice(words, 5000)) + " foul vile foul"))
    docs.append((9001, " ".join(rng.choice(words, 5000))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = toxicity.toxicity_table(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    got = {r.doc_id: r.predicted for r in rows}
    assert got[9000] == 1 and got[9001] == 0
    truth = dict(labels)
    assert np.mean([got[i] == truth[i] for i in truth]) > 0.98


def test_words_before_are_counted(spark):
    """Counts of different words before equal brute force however many there are, in classes and in the corpus."""
    texts = [f"w{i % 3000} common w{i % 7} rare" for i in range(6000)] + ["common", None, ""]
    docs = spark.createDataFrame([(t, i % 2, i // 2 % 2) for i, t in enumerate(texts)], "text string, label int, fold int").repartition(3)
    names = ["common", "rare", "w0"]
    hashes = toxicity._read(pa.array(names))[0]
    words = np.sort(hashes)
    sent = spark.sparkContext.broadcast((words, np.zeros(0, dtype=np.uint64)))
    cut = [(t or "").split() for t in texts]
    pairs = {(b, a) for w in cut for a, b in zip(["", *w], w)}
    seen, total = toxicity._shared_counts(docs, "text", sent)
    place = {n: int(np.searchsorted(words, h)) for n, h in zip(names, hashes)}
    for n in names:
        assert seen[place[n]] == len({p for p in pairs if p[0] == n})
    # Words that no model knows are one word.
    assert total == len({(n if n in names else None, before) for n, before in pairs})
    counts = toxicity._class_counts(docs, sent)
    for fold in (0, 1):
        for label in (0, 1):
            mine = [w for i, w in enumerate(cut) if (i % 2, i // 2 % 2) == (label, fold)]
            for n in names:
                before = {a for w in mine for a, b in zip(["", *w], w) if b == n}
                assert counts[fold, label, place[n]] == min(sum(n in w for w in mine), len(before))


def test_fixed_phrase_of_toxic_texts(spark):
    """Every toxic text starts with the same three words, which no ordinary text has."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(1200):
        text = list(rng.choice(words, 80))
        if i % 6 == 0:
            text = ["zorb", "flim", "quax", *text]
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 6 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = toxicity.toxicity_table(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r.predicted, r.doc_id % 6 == 0) for r in rows if r.held_out]
    assert np.mean([p for p, t in held if t]) > 0.95
    assert np.mean([p for p, t in held if not t]) < 0.02


@pytest.mark.parametrize("by_slot", [True, False])
def test_packed_codes_are_counted(spark, by_slot):
    """Different words beside each expression, over tasks that repeat each other's codes."""
    rng = np.random.default_rng(0)
    slots, names = rng.integers(0, 40, 30_000), rng.integers(0, 1 << 39, 3000)[rng.integers(0, 3000, 30_000)].astype(np.uint64)
    codes = toxicity._codes(slots, names)

    def send(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                held = toxicity._Held(7, by_slot)
                yield from held.add(codes[i * 1000: i * 1000 + 4000])
                yield held.sent()

    got = toxicity._beside_counts(spark.range(0, 30, 1, 3).mapInArrow(send, "part int, codes binary"), 7, 41)
    want = [len({(s, n) for s, n in zip(slots.tolist(), names.tolist()) if s == slot}) for slot in range(40)]
    assert got.tolist() == [*want, 0]
    assert toxicity._pack(codes[:0], 7, by_slot).num_rows == 0


def test_every_labelled_row_teaches_toxicity(spark):
    docs = spark.range(120_000).selectExpr("id as doc_id", "'a text' as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 10 as int) as toxic")
    wanted = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(120_000))
    assert wanted > 50_000
    assert toxicity.labelled_rows(docs, labels).count() == wanted


def test_every_expression_is_counted(spark):
    """Words and pairs of one text, toxic or ordinary, are in the models, and all counts equal brute force."""
    rng = np.random.default_rng(2)
    cut = [[f"w{j}" for j in rng.zipf(1.5, rng.integers(1, 30)) % 500] for _ in range(300)]
    rows = [(" ".join(w), i % 2, i // 2 % 2) for i, w in enumerate(cut)] + [("once toxic", 1, 0), ("once ordinary", 0, 1), (None, 1, 1), ("", 0, 0)]
    cut += [["once", "toxic"], ["once", "ordinary"], [], []]
    docs = spark.createDataFrame(rows, "text string, label int, fold int").repartition(3)
    words = toxicity._vocabulary(docs)
    names = sorted({w for text in cut for w in text})
    hashes = toxicity._read(pa.array(names))[0]
    assert sorted(hashes.tolist()) == words.tolist()
    place = {n: int(np.searchsorted(words, h)) for n, h in zip(names, hashes)}
    sent = spark.sparkContext.broadcast((words, np.zeros(0, dtype=np.uint64)))
    got = {r.code: [r[f"n{g}"] for g in range(4)] for r in toxicity._counted(docs, sent, True, 5).collect()}
    want = {}
    for g in range(4):
        texts, before, after = {}, {}, {}
        for i, (text, (_, label, fold)) in enumerate(zip(cut, rows)):
            if fold * 2 + label != g:
                continue
            for j in range(1, len(text)):
                pair = place[text[j - 1]] << toxicity.WORD_BITS | place[text[j]]
                texts.setdefault(pair, set()).add(i)
                before.setdefault(pair, set()).add(text[j - 2] if j > 1 else None)
                after.setdefault(pair, set()).add(text[j + 1] if j + 1 < len(text) else None)
        for pair in texts:
            want.setdefault(pair, [0] * 4)[g] = min(len(texts[pair]), max(len(before[pair]), len(after[pair])))
    assert got == want
    assert sum(sum(n) == 1 for n in want.values()) > 100


def test_scores_equal_brute_force(spark):
    """Rows of a stored chunk get what all counts at once give, whatever the parts and chunks."""
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(f"w{j}" for j in rng.zipf(1.4, 40) % 300) + (" vile foul" if i % 4 == 0 else ""), "x") for i in range(400)]
    docs += [(None, "vile foul w1", "y")] * 3 + [(1000, None, None), (1001, "never seen", "z")]
    d = spark.createDataFrame(docs, "doc_id long, text string, codes string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    words, (full, gains, curve), pairs, _ = model[0].value, model[1].value, model[2], model[3]
    stored = pairs.toArrow()
    code = stored.column("code").to_numpy()
    counts = np.stack(toxicity._by_class([stored.column(n).to_numpy().astype(float) for n in toxicity.COUNTS]))
    order = np.argsort(code)
    weights = toxicity._pair_gains(code[order], counts[:, order], full)
    want = toxicity._score(toxicity._averages(pa.array([t for _, t, _ in docs], pa.string()), words, gains, code[order].astype(np.uint64), weights), curve)
    got = toxicity.score_documents(d, model).collect()

    def listed(rows):
        return sorted((str(i), str(t), str(c), round(float(x), 6)) for i, t, c, x in rows)

    assert listed(got) == listed((*row, x) for row, x in zip(docs, want))
    # The whole models know words of ordinary texts alone, and say so.
    assert (gains[0] < 0).any() and (gains[0] > 0).any() and curve[:-1].min() >= 0
