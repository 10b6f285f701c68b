from pyspark.sql import functions as F

from corpusqa.functions import text as tx
from corpusqa.functions import vectors as vec
from corpusqa.operators import documents as docs
from corpusqa.operators import reports


def values(df, col):
    return [r[col] for r in df.collect()]


def test_strip_and_collapse_follow_unicode_whitespace(spark):
    samples = ["  a \t\n b  ", "\x1c\x85x　", "  ", "plain", "a b"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").orderBy("i")
    assert values(df.select(tx.strip(F.col("s")).alias("v")), "v") == [s.strip() for s in samples]
    assert values(df.select(tx.collapse(F.col("s")).alias("v")), "v") == [" ".join(s.split()) for s in samples]
    assert values(df.select(tx.word_count(F.col("s")).alias("v")), "v") == [len(s.split()) for s in samples]


def test_short_documents_drop_after_stripping(spark):
    df = spark.createDataFrame([(None,), ("",), (" " * 60,), ("x" * 49,), ("x" * 50,), (" " * 9 + "y" * 50,)], "full_text string")
    assert docs.drop_short_docs(df).count() == 2


def test_flatten_has_two_forms(spark):
    df = spark.createDataFrame([(1, None, ["a", "b"]), (2, "t", None)], "lok_no int, type string, members array<string>")
    fields = ["lok_no", "type", "members"]
    assert [tuple(r) for r in docs.flatten_metadata(df, fields).collect()] == [("1", "", "a, b"), ("2", "t", "")]
    kept = docs.flatten_metadata(df, fields, nulls="keep", cast=False)
    assert [tuple(r) for r in kept.collect()] == [(1, None, "a, b"), (2, "t", None)]


def test_members_from_array_and_string(spark):
    arrays = spark.createDataFrame([(1, [" a ", "", "b", " "]), (2, None)], "id int, members array<string>")
    strings = spark.createDataFrame([(1, " a ,, b , "), (2, None)], "id int, members string")
    for df in (arrays, strings):
        assert sorted(values(docs.explode_members(df), "mp")) == ["a", "b"]


MEMBERS = ["Member 1", "Member 12", "member 1", "50% A_B", "50x AzB", 'BAIJAYANT "JAY" PANDA']


def test_member_filter_is_a_literal_substring(spark):
    df = spark.createDataFrame([(m, "A  B") for m in MEMBERS], "members string, ministry string")
    assert df.where(docs.members_filter(["Member 1"])).count() == 2
    assert df.where(docs.members_filter(["50% A_B"])).count() == 1
    assert df.where(docs.members_filter(['"JAY"', "member"])).count() == 2
    assert df.where(docs.metadata_filter()).count() == len(MEMBERS)
    assert df.where(docs.metadata_filter(["Member 1"], "A B")).count() == 0
    assert docs.select_where(df, ["members"], names=["Member 1"], ministry="A  B", limit=1).count() == 1


def test_request_filter_checks_only_what_is_given(spark):
    rows = [(None, None), ([], ""), (["Member 1"], None), (None, "X"), (["Member 2"], "A")]
    df = spark.createDataFrame(
        [(n, w, "Member 12", "A") for n, w in rows], "names array<string>, wanted_ministry string, members string, ministry string")
    assert values(df.select(docs.request_matches().alias("m")), "m") == [True, True, True, False, False]


def test_unit_vector_and_inner_product(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    units = [[round(x, 6) for x in r["u"]] for r in df.select(vec.unit("a").alias("u")).collect()]
    assert units == [[0.6, 0.8], [0.0, 0.0]]
    assert values(df.select(vec.inner_product("a", "b").alias("p")), "p") == [11.0, 0.0]


def test_storage_labels(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1048576,), (1572864,)], "kb bigint")
    assert values(df.select(tx.size_label("kb").alias("v")), "v") == ["0 KB", "1023 KB", "1.0 MB", "1.5 MB", "1.0 GB", "1.5 GB"]
    size = spark.range(1).select(reports.storage_bytes(F.lit(770_000), 1024, True).alias("b")).first()["b"]
    assert size == int(770_000 * 1024 * 4 * 2.5 + 770_000 * 300 + 770_000 * 500)


def test_extraction_report(spark):
    rows = [("e1", "a", 1.0, 2.0, "x" * 60, None), ("e1", "b", 3.0, 4.0, "short", None), ("e1", "c", 9.0, 9.0, None, "Err: x")]
    df = spark.createDataFrame(rows, "engine string, stem string, time_sec double, mem_peak_delta_mb double, text string, error string")
    measured = reports.extraction_rows(df)
    assert sorted(values(measured, "char_count")) == [0, 5, 60]
    total = reports.engine_totals(measured).first().asDict()
    assert total == {"engine": "e1", "runs": 2, "total_time": 4.0, "avg_time": 2.0, "chars": 65, "avg_mem": 3.0, "empty": 1}
    existing = spark.createDataFrame([("a", 50), ("b", 9), ("z", 1)], "stem string, existing_chars int")
    diffs = {r["stem"]: r["diff_text"] for r in reports.compare_existing(measured, existing).collect()}
    assert diffs == {"a": "+10", "b": "-4"}
