"""Name resolution: the dictionary-order rules, on hand-made registries."""

from pyspark.sql import functions as F

from corpusqa.operators import documents as docs
from corpusqa.operators import entities as ent

REGISTRY = "lok int, pos bigint, mpNo int, mpName string"


def mapped(spark, rows):
    return {r["name"]: r["canonical"] for r in ent.canonical_names(spark.createDataFrame(rows, REGISTRY)).collect()}


def test_highest_term_gives_the_canonical_name(spark):
    rows = [(16, 0, 5, "RAHUL GANDHI"), (17, 0, 5, "Rahul Gandhi"), (18, 0, 5, "Shri Rahul Gandhi"), (17, 1, 6, "A")]
    names = mapped(spark, rows)
    assert names == {"RAHUL GANDHI": "Shri Rahul Gandhi", "Rahul Gandhi": "Shri Rahul Gandhi",
                     "Shri Rahul Gandhi": "Shri Rahul Gandhi", "A": "A"}


def test_a_shared_name_goes_to_the_number_seen_later(spark):
    rows = [(16, 0, 1, "SAME"), (16, 1, 2, "SAME"), (17, 0, 1, "First"), (17, 1, 2, "Second")]
    assert mapped(spark, rows)["SAME"] == "Second"
    rows = [(16, 0, 2, "SAME"), (16, 1, 1, "SAME"), (17, 0, 1, "First"), (17, 1, 2, "Second")]
    assert mapped(spark, rows)["SAME"] == "First"


def test_the_first_entry_of_a_term_wins(spark):
    rows = [(17, 0, 9, "One"), (17, 1, 9, "Two")]
    assert mapped(spark, rows) == {"One": "One", "Two": "One"}


def test_missing_numbers_and_names_drop_out(spark):
    rows = [(17, 0, 0, "Zero"), (17, 1, None, "None"), (17, 2, 3, ""), (17, 3, 4, None), (17, 4, 5, "Kept")]
    assert mapped(spark, rows) == {"Kept": "Kept"}


def test_alias_lists_are_sorted_and_hold_the_canonical_name(spark):
    names = spark.createDataFrame([("b", "C"), ("a", "C"), ("x", "x")], "name string, canonical string")
    aliases = {r["canonical"]: r["aliases"] for r in ent.alias_map(names).collect()}
    assert aliases == {"C": ["C", "a", "b"], "x": ["x"]}
    summary = ent.name_map_summary(names).first().asDict()
    assert summary == {"names": 3, "remapped": 2, "canonicals": 2, "multi_alias": 1}


def test_unknown_member_falls_back_to_itself(spark):
    aliases = spark.createDataFrame([("C", ["C", "a"])], "canonical string, aliases array<string>")
    requests = spark.createDataFrame([(1, "C"), (2, "Other"), (3, None), (4, "")], "query_id int, mp string")
    names = {r["query_id"]: r["names"] for r in ent.resolve_requests(requests, aliases).collect()}
    assert names == {1: ["C", "a"], 2: ["Other"], 3: None, 4: None}


CORPUS = ("lok_no int, session_no int, ques_no int, type string, date string, ministry string, subject string, "
          "members array<string>, pos int")


def corpus(spark):
    rows = [
        (17, 1, 1, "STARRED", "2019-01-01", " A  B ", "old", ["x"], 0),
        (17, 1, 1, "STARRED", "2019-01-02", "  ", "", ["X", " y ", "X", ""], 1),
        (17, 1, 2, None, None, "A", None, ["x"], 2),
        (17, 1, 2, None, None, "B", None, ["z"], 3),
        (17, None, 3, "STARRED", None, "A", None, ["x"], 4),
        (None, 1, 3, "STARRED", None, "A", None, ["x"], 5),
        (17, 1, None, "STARRED", None, "A", None, ["x"], 6),
        (17, 1, 4, "STARRED", None, None, "s", None, 7),
    ]
    return spark.createDataFrame(rows, CORPUS)


NAMES = [("x", "X")]


def test_last_row_wins_and_null_types_stay(spark):
    got = ent.build_questions(corpus(spark), [F.desc("pos")]).collect()
    rows = sorted((r["ques_no"], r["type"] or "", r["date"] or "", r["ministry"] or "", r["subject"] or "") for r in got)
    assert rows == [(1, "STARRED", "2019-01-02", "", ""), (2, "", "", "A", ""), (2, "", "", "B", ""), (4, "STARRED", "", "", "s")]
    one = [r for r in got if r["ques_no"] == 1][0]
    assert one["ministry"] is None and one["subject"] is None


def test_links_replace_and_keep_duplicates(spark):
    names = spark.createDataFrame(NAMES, "name string, canonical string")
    got = sorted((r["ques_no"], r["mp_name"]) for r in ent.build_links(corpus(spark), names, [F.desc("pos")]).collect())
    assert got == [(1, "X"), (1, "X"), (1, "y"), (2, "X"), (2, "z")]


def test_counts_cover_replaced_rows(spark):
    names = spark.createDataFrame(NAMES, "name string, canonical string")
    assert ent.build_counts(corpus(spark), names).first().asDict() == {"questions": 5, "links": 6, "renamed": 2}


def test_null_types_never_join(spark):
    questions = ent.build_questions(corpus(spark), [F.desc("pos")])
    links = ent.build_links(corpus(spark), spark.createDataFrame(NAMES, "name string, canonical string"), [F.desc("pos")])
    assert {r["ques_no"] for r in ent.asked_questions(questions, links).collect()} == {1}


def test_ministry_names_are_stripped_and_distinct(spark):
    rows = spark.createDataFrame([("A ",), ("A",), (" B\t",), ("",), (" ",), (None,)], "minName string")
    assert [r["name"] for r in ent.all_ministry_names(rows).collect()] == ["A", "B"]


def test_search_is_case_insensitive(spark):
    rows = spark.createDataFrame([("Smt. Supriya Sule",), ("50%_x",)], "name string")
    assert docs.search_names(rows, "SUPRIYA").count() == 1
    assert docs.search_names(rows, "%").count() == 1
