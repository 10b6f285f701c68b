from pyspark.sql import functions as F

from corpusqa import schemas
from corpusqa.operators import evaluation as ev
from corpusqa.operators import prompts, rerank
from corpusqa.operators.evidence import source_rows

CHUNK = "query_id string, rank int, score double, chunk_id string, qa_id string, text string, subject string, members string, ministry string"

CASES = [
    ("q1", "rail?", "mp_specific", "Shri X", None, (["X Y"], None, None), ""),
    ("q2", "tax?", "ministry_specific", None, "A  B", (None, "A B", None), ""),
    ("q3", "any?", "topic_search", None, None, (None, None, ["Rem  desivir", "grid"]), ""),
    ("q4", "none?", "topic_search", None, None, (None, None, None), ""),
    ("q5", "empty?", "topic_search", None, None, (None, None, ["x"]), ""),
]
FOUND = [
    ("unfiltered:q1", 1, 0.9, "a#0", "a", "t", "s", "OTHER", "M"),
    ("unfiltered:q1", 2, 0.8, "b#0", "b", "t", "s", "Shri  x", "M"),
    ("filtered:q1", 1, 0.8, "b#0", "b", "t", "s", "Shri  x", "M"),
    ("filtered:q1", 2, 0.7, "b#1", "b", "t", "s", "x  y, z", None),
    ("unfiltered:q2", 1, 0.9, "c#0", "c", "t", "s", "", " A B "),
    ("filtered:q2", 1, 0.9, "c#0", "c", "t", "s", None, "a b"),
    ("unfiltered:q3", 1, 0.9, "d#0", "d", "no rem desivir", "s", "", ""),
    ("unfiltered:q3", 2, 0.9, "e#0", "e", None, "Power GRID", "", ""),
    ("unfiltered:q4", 1, 0.9, "f#0", "f", "t", None, None, None),
]


def evaluated(spark):
    cases = spark.createDataFrame(CASES, schemas.EVAL_CASE)
    aliases = spark.createDataFrame([("Shri X", ["SHRI X", "X Y"])], schemas.ALIASES)
    requests = ev.eval_requests(ev.effective_expected(cases, aliases))
    judged = ev.judge(requests, spark.createDataFrame(FOUND, CHUNK))
    return requests, judged, ev.score_retrieval(requests, judged)


def test_filtered_requests_only_where_a_filter_exists(spark):
    requests, _, _ = evaluated(spark)
    rows = {r["query_id"]: r for r in requests.collect()}
    assert set(rows) == {f"unfiltered:q{i}" for i in range(1, 6)} | {"filtered:q1", "filtered:q2"}
    assert rows["filtered:q1"]["names"] == ["SHRI X", "X Y"] and rows["unfiltered:q1"]["names"] is None
    assert rows["filtered:q2"]["ministry"] == "A  B" and rows["unfiltered:q2"]["ministry"] is None


def test_scores(spark):
    _, _, scores = evaluated(spark)
    got = {r["query_id"]: (r["precision_at_k"], r["hit_at_1"], r["hit_at_k"], r["unique_docs"], r["k"]) for r in scores.collect()}
    assert got == {
        "unfiltered:q1": (0.5, False, True, 2, 2),
        "filtered:q1": (1.0, True, True, 1, 2),
        "unfiltered:q2": (1.0, True, True, 1, 1),
        "filtered:q2": (0.0, False, False, 1, 1),
        # The text is collapsed, the term is not; the second chunk matches by subject.
        "unfiltered:q3": (0.5, False, True, 2, 2),
        "unfiltered:q4": (1.0, True, True, 1, 1),
        "unfiltered:q5": (0.0, False, False, 0, 0),
    }


def test_summary_and_report(spark):
    requests, _, _ = evaluated(spark)
    judged = ev.judge(requests, spark.createDataFrame(FOUND, CHUNK))
    latency = requests.select("query_id", F.lit(154.4).alias("latency_ms"))
    scores = ev.score_retrieval(requests, judged, latency)
    summary = {r["mode"]: r for r in ev.summary_by_mode(scores).collect()}
    assert summary["filtered"]["avg_precision_at_k"] == 0.5 and summary["filtered"]["count"] == 2
    assert round(summary["unfiltered"]["avg_precision_at_k"], 6) == 0.6
    report = ev.report_rows(scores).collect()
    assert [(r["test_id"], r["mode"]) for r in report][:3] == [("q1", "unfiltered"), ("q1", "filtered"), ("q2", "unfiltered")]
    assert report[0]["p_at_k"] == "0.50" and report[0]["hit_1"] == "N" and report[0]["latency"] == "154ms"


def test_failures_name_the_values_that_failed(spark):
    _, judged, scores = evaluated(spark)
    rows = {(r["test_id"], r["mode"], r["rank"]): (r["verdict"], r["reasons"]) for r in ev.failures(scores, judged).collect()}
    assert rows[("q1", "unfiltered", 1)] == ("FAIL", "members='OTHER'")
    assert rows[("q1", "unfiltered", 2)] == ("PASS", "")
    assert rows[("q2", "filtered", 1)] == ("FAIL", "ministry='a b'")
    assert rows[("q3", "unfiltered", 1)] == ("FAIL", "subject='s'")
    assert not any(key[0] == "q4" for key in rows)


CANDIDATES = [
    (1, "rail road", "c1", "rail", 0.5, 1), (1, "rail road", "c2", "road by rail", 0.4, 2), (1, "rail road", "c3", "none", 0.3, 3),
    (2, "tax", "c4", "tax", 0.1, 1),
]


def candidates(spark):
    return spark.createDataFrame(CANDIDATES, "query_id int, query string, chunk_id string, text string, score double, rank int")


def test_rerank_by_coverage_and_by_a_model(spark):
    kept = [(r["query_id"], r["rank"], r["chunk_id"]) for r in rerank.rerank(candidates(spark), n=2).orderBy("query_id", "rank").collect()]
    assert kept == [(1, 1, "c2"), (1, 2, "c1"), (2, 1, "c4")]

    def shortest():
        return lambda queries, texts: [-len(t) for t in texts]

    kept = rerank.rerank(candidates(spark), shortest, 1).orderBy("query_id").collect()
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in kept] == [(1, "c1", -4.0), (2, "c4", -3.0)]


def test_prompts_and_answers(spark):
    queries = spark.createDataFrame(
        [(1, "rail road {x}", "E {context_str}"), (2, "tax", None), (3, "nothing", "")], "query_id int, query string, evidence string")
    built = {r["query_id"]: r["prompt"] for r in prompts.build_prompts(queries, candidates(spark)).collect()}
    assert built[1] == prompts.EVIDENCE_TEMPLATE.replace("{evidence_str}", "E#").replace("{query_str}", "rail road {x}").replace(
        "{context_str}", "rail\n\nroad by rail\n\nnone").replace("E#", "E {context_str}")
    assert built[2] == prompts.PLAIN_TEMPLATE.replace("{query_str}", "tax").replace("{context_str}", "tax")
    assert built[3] == prompts.PLAIN_TEMPLATE.replace("{query_str}", "nothing").replace("{context_str}", "")

    chunks = spark.createDataFrame(
        [(1, 2, "b", None, "M", None, " text "), (1, 1, "a", 0.12345, None, "S", "y" * 300)],
        "query_id int, rank int, qa_id string, score double, ministry string, subject string, text string")
    sources = source_rows(chunks)
    answers = prompts.answer(prompts.build_prompts(queries, candidates(spark)), lambda: (lambda p: [x[-7:] for x in p]), sources)
    rows = {r["query_id"]: r for r in answers.collect()}
    assert rows[1]["answer"] == "Answer:" and rows[2]["sources"] is None
    first, second = rows[1]["sources"]
    assert (first["qa_id"], first["score_text"], first["ministry"], first["excerpt"]) == ("a", "0.123", "", "y" * 200 + "...")
    assert (second["score_text"], second["subject"], second["excerpt"]) == ("n/a", "unknown", "text...")
