"""Importance resampling and fill-in-the-middle against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusqa.llm import infilling, queries, resampling

SF_DIR = "/root/testdata/sf0.001"


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_buckets(text, most=1, buckets=10_000):
    words = brute_words(text)
    runs = [" ".join(words[i:i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]
    return Counter(zlib.crc32(r.encode()) % buckets for r in runs)


def brute_resample(docs, target, most=1, buckets=10_000, least=20, percent=10, seed=2024):
    found = [brute_buckets(t, most, buckets) for _, t in docs]
    corpus, wanted = sum(found, Counter()), sum((brute_buckets(t, most, buckets) for t in target), Counter())
    s_all, t_all = corpus.total(), wanted.total()
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for (key, text), f in zip(docs, found):
        n = f.total()
        weight = sum(gain[b] * c for b, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = [r for r, (_, t) in zip(rows, docs) if len(brute_words(t)) >= least]
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i in range(percent * len(fit) // 100):
        fit[i][4] = i + 1
    return Counter(map(tuple, rows))


def test_resample_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    target = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    got = queries.QUERIES["op12_resample"](spark, SF_DIR)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert Counter(map(tuple, got.collect())) == brute_resample(plain(docs), target)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_resample_on_edges(spark, edge_docs, edge_rows, no_docs, most):
    target = spark.createDataFrame([("alpha beta word5 word6",), (None,), ("zero byte",)], "text string")
    docs = edge_docs.withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    options = {"most": most, "buckets": 97, "least_words": 1, "percent": 60}
    got = resampling.resample(docs, target, **options)
    assert set(edge_docs.columns) - {"text"} < set(got.columns)
    want = brute_resample([(r[0], r[1]) for r in edge_rows], ["alpha beta word5 word6", None, "zero byte"], most, 97, 1, 60)
    rows = Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert rows == want
    assert resampling.resample(no_docs, target).count() == 0
    nothing = resampling.resample_table(edge_docs, target.where("false")).collect()
    assert len(nothing) == len(edge_rows)


def test_ranks_with_a_third_of_rows_alike(spark):
    rows = [(i if i % 3 else None, " ".join(f"w{(i if i % 3 else 1) * j % 50}" for j in range(30))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    got = resampling.resample(docs, target, percent=50)
    want = brute_resample(rows, ["w1 w2 w3"], percent=50)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == want
    assert sorted(r.rank for r in got.where("rank is not null").collect()) == list(range(1, 451))


def test_a_draw_moves_towards_the_target(spark):
    rows = [(i, " ".join(f"{'near' if i % 10 == 0 else 'far'}{(i + j * j) % 40}" for j in range(60))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(f"near{j}" for j in range(40)),)] * 100, "text string")
    drawn = [r.doc_id for r in resampling.resample(docs, target).where("rank is not null").collect()]
    assert len(drawn) == 200 and sum(k % 10 == 0 for k in drawn) > 160


def brute_infill(key, text, seed=42, infill=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= infill:
        return key, n, "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return key, n, form, len(p), len(m), out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_infill_query_equals_brute_force(spark):
    docs = plain(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    got = queries.QUERIES["op13_infill"](spark, SF_DIR)
    want = Counter((*brute_infill(k, t)[:5], sha(brute_infill(k, t)[5]), sha(t or "")) for k, t in docs)
    assert Counter(map(tuple, got.collect())) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


MARKED = [
    (100 + i, t) for i, t in enumerate([
        "a <P> b", "<S>", "x<M>y z", "< P > fine", "ends with <", "<P", "a <S b < M <", "  lead and trail  ", "\x0b\x0c\n", "\x00 \x1c\x1d \x85  x",
        "😀 漢字 é\tü", "a" * 70_000, "word " * 30_000, "<<P <<S <<M", "\\1 \\0 \\\\", "ÿ þ \xff"])
]


@pytest.mark.parametrize("infill,spm", [(50, 80), (100, 50), (0, 0)])
def test_infill_on_edges(spark, edge_docs, edge_rows, no_docs, infill, spm):
    more = spark.createDataFrame([(k + j * 1000, t) for k, t in MARKED for j in range(6)], "doc_id long, text string")
    docs = edge_docs.withColumn("form", F.lit(5)).unionByName(more, allowMissingColumns=True)
    plain_rows = [(r[0], r[1]) for r in edge_rows] + [(k + j * 1000, t) for k, t in MARKED for j in range(6)]
    got = infilling.infill(docs, infill_percent=infill, spm_percent=spm)
    assert got.columns == [c for c in docs.columns if c != "form"] + list(infilling.RESULTS)
    rows = got.select("doc_id", *infilling.RESULTS, infilling.restored(F.col("output"), F.col("form")).alias("back"), "text").collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter(brute_infill(k, t, 42, infill, spm) for k, t in plain_rows)
    # The round trip is exact.
    assert all(r.back == (r.text or "") for r in rows)
    assert infilling.infill(no_docs).count() == 0
