"""Profiles and evidence text on hand-made tables."""

from pyspark.sql import functions as F

from corpusqa.operators import evidence as ev
from corpusqa.operators import entities as ent
from corpusqa.operators import profiles as pr
from corpusqa.plans.evidence import evidence_for

Q = "lok_no int, session_no int, ques_no int, type string, date string, ministry string, subject string"
L = "lok_no int, session_no int, ques_no int, type string, mp_name string"

QUESTIONS = [
    (17, 2, 1, "STARRED", "2019-06-01", "HEALTH", " Beds "),
    (17, 10, 2, "UNSTARRED", "2021-03-01", "RAILWAYS", None),
    (18, 1, 3, "UNSTARRED", None, None, "Roads"),
    (18, 1, 4, "UNSTARRED", "2024-07-01", "POWER", "Grid"),
    (18, 1, 5, None, "2024-07-02", "POWER", "Untyped"),
]
LINKS = [
    (17, 2, 1, "STARRED", "A"), (17, 2, 1, "STARRED", "A"), (17, 10, 2, "UNSTARRED", "A"),
    (18, 1, 3, "UNSTARRED", "A"), (18, 1, 4, "UNSTARRED", "A"), (18, 1, 4, "UNSTARRED", "B"), (18, 1, 5, None, "B"),
]

MEMBER_A = """=== MP STATISTICS ===
MP Name: A
Total questions asked: 5

By Lok Sabha:
  Lok 17: 3
  Lok 18: 2

By Session:
  Lok 17 Session 10: 1
  Lok 17 Session 2: 2
  Lok 18 Session 1: 2

By Type:
  STARRED: 2
  UNSTARRED: 3

Top Ministries:
     2  HEALTH
     1  POWER
     1  RAILWAYS
     1  None

Recent Questions (3):
  1. [Lok 18, Session 1, Q4, UNSTARRED] POWER — Grid (2024-07-01)
  2. [Lok 17, Session 10, Q2, UNSTARRED] RAILWAYS —  (2021-03-01)
  3. [Lok 17, Session 2, Q1, STARRED] HEALTH — Beds (2019-06-01)

NOTE: Statistics cover ALL questions by this MP, including those whose full text may not appear in the retrieved chunks.
=== END MP STATISTICS ==="""

POWER = """=== MINISTRY STATISTICS ===
Ministry: POWER
Total questions received: 2

By Lok Sabha:
  Lok 18: 2

By Type:
  None: 1
  UNSTARRED: 1

Top MPs asking this ministry:
     1  A
     1  B

Recent Questions (2):
  1. [Lok 18, Session 1, Q5, None] POWER — Untyped (2024-07-02)
  2. [Lok 18, Session 1, Q4, UNSTARRED] POWER — Grid (2024-07-01)

NOTE: Statistics cover ALL questions to this ministry, including those whose full text may not appear in the retrieved chunks.
=== END MINISTRY STATISTICS ==="""

OVERLAP = """=== OVERLAP: A × POWER ===
Questions from this MP to this Ministry: 1
By Type: UNSTARRED: 1

Recent Questions (1):
  1. [Lok 18, Session 1, Q4, UNSTARRED] POWER — Grid (2024-07-01)

=== END OVERLAP ==="""


def tables(spark):
    questions, links = spark.createDataFrame(QUESTIONS, Q), spark.createDataFrame(LINKS, L)
    return questions, ent.asked_questions(questions, links)


def profiles(spark, top_q=10):
    questions, asked = tables(spark)
    return (pr.member_profiles(asked, top_q=top_q), pr.ministry_profiles(questions, asked, top_q=top_q),
            pr.overlap_profiles(asked, top_q=top_q))


def test_member_text(spark):
    members, _, _ = profiles(spark)
    texts = {r["mp_name"]: r["t"] for r in members.select("mp_name", ev.member_text(3).alias("t")).collect()}
    assert texts["A"] == MEMBER_A


def test_ministry_text(spark):
    _, ministries, _ = profiles(spark)
    texts = {r["ministry"]: r["t"] for r in ministries.select("ministry", ev.ministry_text().alias("t")).collect()}
    assert set(texts) == {"HEALTH", "RAILWAYS", "POWER"}
    assert texts["POWER"] == POWER


def test_null_dates_come_last_and_show_as_missing(spark):
    members, _, _ = profiles(spark)
    recent = members.where("mp_name = 'A'").first()["recent"]
    assert [q["ques_no"] for q in recent] == [4, 2, 1, 1, 3]
    text = members.where("mp_name = 'A'").select(ev.question_list_text(members["recent"]).alias("t")).first()["t"]
    assert "  5. [Lok 18, Session 1, Q3, UNSTARRED] None — Roads (N/A)\n" in text


def test_a_ministry_nobody_linked_asks_about_keeps_its_profile(spark):
    questions = spark.createDataFrame([(1, 1, 1, "S", "2020-01-01", "ALONE", "x")], Q)
    asked = ent.asked_questions(questions, spark.createDataFrame([], L))
    row = pr.ministry_profiles(questions, asked).first()
    assert row["total_questions"] == 1 and row["top_mps"] == []


def test_evidence_packets(spark):
    requests = spark.createDataFrame(
        [(1, "A", "POWER"), (2, "A", None), (3, None, "POWER"), (4, None, None), (5, "Nobody", None), (6, "Nobody", "POWER"),
         (7, "", "")],
        "query_id int, mp string, ministry string")
    got = {r["query_id"]: r["evidence"] for r in ev.evidence_packets(requests, *profiles(spark)).collect()}
    five = got[2]
    assert got[1] == "\n\n".join([OVERLAP, five, POWER])
    assert got[3] == POWER and got[6] == POWER
    assert got[4] is None and got[5] is None and got[7] is None
    questions, asked = tables(spark)
    assert {r["query_id"]: r["evidence"] for r in evidence_for(requests, questions, asked).collect()} == got
    # Half of four is below the minimum of three.
    few = {r["query_id"]: r["evidence"] for r in ev.evidence_packets(requests, *profiles(spark, 4), top_q=4).collect()}
    assert few[1] == "\n\n".join([OVERLAP, MEMBER_A, POWER])
    assert "Recent Questions (4):" in few[2]


def test_equal_counts_keep_newest_first(spark):
    rows = [(1, 1, i, "S", f"2020-01-0{i}", m, "") for i, m in enumerate(["Z", "A", "M"], 1)]
    questions = spark.createDataFrame(rows, Q)
    links = questions.selectExpr("lok_no", "session_no", "ques_no", "type", "'X' mp_name")
    top = pr.member_profiles(ent.asked_questions(questions, links)).first()["by_ministry"]
    assert [t["key"] for t in top] == ["M", "A", "Z"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rows_go_to_tasks_of_bounded_size(spark, monkeypatch):
    """The same profiles, null keys and repeated links included, from as many tasks as the rows ask for."""
    monkeypatch.setattr(pr, "ROWS_PER_TASK", 2)
    _, asked = tables(spark)
    asked = asked.unionByName(asked.withColumn("mp_name", F.lit(None).cast("string")))
    parts = pr.parts_of(asked)
    assert parts == 6 and pr.parts_of(asked.limit(0)) == spark.sparkContext.defaultParallelism
    for keys in (["mp_name"], ["mp_name", "ministry"]):
        fine = pr.fine_counts(asked, keys, parts=parts)
        assert fine.rdd.getNumPartitions() == pr.breakdowns(fine, keys, parts=parts).rdd.getNumPartitions() == parts
        assert rows_of(pr.breakdowns(fine, keys, parts=parts)) == rows_of(pr.breakdowns(pr.fine_counts(asked, keys), keys))
        assert rows_of(pr.recent_questions(asked, keys, parts=parts)) == rows_of(pr.recent_questions(asked, keys))
    top = pr.top_categories(asked, ["mp_name"], "ministry", parts=parts)
    assert rows_of(top) == rows_of(pr.top_categories(asked, ["mp_name"], "ministry"))
    assert rows_of(pr.member_profiles(asked, parts=parts)) == rows_of(pr.member_profiles(asked))
    assert rows_of(pr.overlap_profiles(asked, parts=parts)) == rows_of(pr.overlap_profiles(asked))
