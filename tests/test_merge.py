"""Metadata tables that grow by merges."""

import pytest
from pyspark.sql import functions as F

from corpusqa import schemas
from corpusqa.operators import documents as docs
from corpusqa.operators import entities as ent
from corpusqa.sources import merge

REGISTRY = [(17, 1, 1, "Shri A"), (17, 2, 2, "B")]
SCHEMA = "lok_no int, session_no int, ques_no int, type string, date string, ministry string, subject string, members string, at int"


def question(at, term, session, number, kind="S", members="A, B", subject="s"):
    return (term, session, number, kind, "2020-01-01", "M", f"{subject}{at}", members, at)


@pytest.fixture
def names(spark):
    return spark.createDataFrame(REGISTRY, "lok int, pos int, mpNo int, mpName string")


ROWS = [
    question(1, 16, 1, 1), question(2, 16, 1, 2, members="B, B"), question(3, 17, 1, 1), question(4, 17, 2, 1, members=None),
    question(5, 17, 2, 1, members="C"), question(6, 16, 1, 2, members="A"), question(7, 17, None, 3), question(8, None, None, 4, kind=None),
    question(9, 17, None, 3, members="C, A"), question(10, None, None, 4, kind=None), question(11, 18, 1, 1, kind=""), question(12, 16, 1, 9),
]


def content(tables):
    return [sorted((tuple(r) for r in t.collect()), key=repr) for t in tables]


def built(frame, names):
    order = [F.desc("at")]
    canonical = ent.canonical_names(names)
    return content([ent.build_questions(frame, order), ent.build_links(frame, canonical, order)])


@pytest.mark.parametrize("cuts", [[12], [5, 12], [1, 2, 3, 7, 8, 12]])
def test_merges_equal_one_build(spark, names, tmp_path, cuts):
    root, start = str(tmp_path), 0
    for stop in cuts:
        part = spark.createDataFrame(ROWS[start:stop], SCHEMA)
        merge.merge_metadata(part, names, [F.desc("at")], root)
        start = stop
    assert content(merge.read_metadata(spark, root)) == built(spark.createDataFrame(ROWS, SCHEMA), names)


def test_counts_of_a_merge(spark, names, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    first = merge.merge_metadata(frame(ROWS[:3]), names, [F.desc("at")], str(tmp_path))
    assert first == {"questions": 3, "replaced_questions": 0, "question_mps": 6, "replaced_question_mps": 0}
    second = merge.merge_metadata(frame(ROWS[5:6]), names, [F.desc("at")], str(tmp_path))
    assert second == {"questions": 1, "replaced_questions": 1, "question_mps": 1, "replaced_question_mps": 2}
    nothing = merge.merge_metadata(frame([]), names, [F.desc("at")], str(tmp_path))
    assert set(nothing.values()) == {0}
    assert [t.count() for t in merge.read_metadata(spark, str(tmp_path))] == [3, 5]


def test_a_merge_cut_short_is_not_seen(spark, names, tmp_path, monkeypatch):
    """Between the two tables, or before the commit: readers keep the version before, and the next run succeeds."""
    root, order = str(tmp_path), [F.desc("at")]
    first, second = spark.createDataFrame(ROWS[:5], SCHEMA), spark.createDataFrame(ROWS[5:], SCHEMA)
    merge.merge_metadata(first, names, order, root)
    before = content(merge.read_metadata(spark, root))

    def broken(*_):
        raise RuntimeError("lost")

    for name in ("_commit", "_stored"):
        with monkeypatch.context() as patch:
            if name == "_stored":
                stored = merge._stored
                patch.setattr(merge, name, lambda s, r, table, p: broken() if table == "question_mps" else stored(s, r, table, p))
            else:
                patch.setattr(merge, name, broken)
            with pytest.raises(RuntimeError):
                merge.merge_metadata(second, names, order, root)
        assert content(merge.read_metadata(spark, root)) == before
    merge.merge_metadata(second, names, order, root)
    assert content(merge.read_metadata(spark, root)) == built(spark.createDataFrame(ROWS, SCHEMA), names)


def test_a_merge_writes_what_it_touches(spark, names, tmp_path):
    root, order = str(tmp_path), [F.desc("at")]
    merge.merge_metadata(spark.createDataFrame(ROWS[:5], SCHEMA), names, order, root)
    merge.merge_metadata(spark.createDataFrame(ROWS[5:6], SCHEMA), names, order, root)
    written = spark.read.schema(schemas.QUESTIONS).option("basePath", f"{root}/questions").parquet(f"{root}/questions/generation=2")
    assert {(r.lok_no, r.session_no) for r in written.collect()} == {(16, 1)}


def test_no_tables_yet(spark, tmp_path):
    questions, links = merge.read_metadata(spark, str(tmp_path / "none"))
    assert questions.count() == links.count() == 0 and links.columns == schemas.LINKS.fieldNames()


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_links_are_made_in_compiled_code(spark, names):
    """Functions over arrays are interpreted, not compiled."""
    latest = spark.createDataFrame(ROWS, SCHEMA)
    assert "lambdafunction" not in plan(ent.links_of(latest, ent.canonical_names(names)))


def test_ranks_sort_by_the_number_first(spark):
    """Terms are few, so a sort that starts with them compares whole rows."""
    sorts = [line for line in plan(ent.latest_questions(spark.createDataFrame(ROWS, SCHEMA), [F.desc("at")])).splitlines() if "Sort [" in line]
    assert sorts and all("Sort [ques_no" in line for line in sorts)


def test_new_rows_of_a_merge_are_gathered_once(spark, names, tmp_path, monkeypatch):
    """New rows of the tables are not shuffled again by partition: only the kept ones are."""
    root, order, gathered = str(tmp_path), [F.desc("at")], []
    merge.merge_metadata(spark.createDataFrame(ROWS[:5], SCHEMA), names, order, root)
    union = type(names).unionByName

    def seen(frame, other, *args, **kwargs):
        gathered.append("rebalance" in frame._jdf.queryExecution().analyzed().toString().lower())
        return union(frame, other, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(type(names), "unionByName", seen)
        merge.merge_metadata(spark.createDataFrame(ROWS[5:], SCHEMA), names, order, root)
    assert gathered.count(True) == len(merge.TABLES)
    assert content(merge.read_metadata(spark, root)) == built(spark.createDataFrame(ROWS, SCHEMA), names)


@pytest.mark.parametrize("members", [[" A , \t , B,, C d \x1c"], [None], [""], [" ,\x85,"], ["é é, A\x00"]])
def test_names_are_stripped_as_before(spark, members):
    rows = spark.createDataFrame([(m,) for m in members], "members string")
    want = [name.strip() for m in members if m for name in m.split(",") if name.strip()]
    assert [r.mp for r in docs.explode_members(rows).collect()] == want
    listed = spark.createDataFrame([(m.split(",") + [None] if m is not None else None,) for m in members], "members array<string>")
    assert [r.mp for r in docs.explode_members(listed).collect()] == want
