import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusqa.operators import chunking, incremental

WORDS = st.text(alphabet="abé.!?", min_size=1, max_size=4)
TEXTS = st.lists(st.tuples(WORDS, st.sampled_from([" ", "\n", "  ", "\t", "\n\n", "  "])), max_size=60).map(
    lambda parts: "".join(w + s for w, s in parts))


def sentences(text):
    """The rule as a pattern, independent of the implementation."""
    return [s.split() for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.split()]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 12), st.integers(0, 12))
def test_chunks_cover_the_tokens_in_order(text, size, overlap):
    chunks = chunking.pack(text, size, overlap)
    rebuilt = []
    for body, n_tokens, n_repeated in chunks:
        tokens = body.split()
        assert len(tokens) == n_tokens <= size and n_repeated <= overlap
        assert rebuilt[len(rebuilt) - n_repeated:] == tokens[:n_repeated]
        assert n_repeated < n_tokens
        rebuilt += tokens[n_repeated:]
    assert rebuilt == text.split()
    assert bool(chunks) == bool(text.strip())


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_a_short_sentence_is_never_cut(text):
    size = 5
    pieces = list(chunking._pieces(text, size))
    expected = []
    for s in sentences(text):
        expected += [s[i : i + size] for i in range(0, len(s), size)]
    assert pieces == expected


def test_a_run_is_repeatable(spark):
    rows = [("a", "One two. Three four five. Six."), ("b", " \n "), ("c", None), ("d", "x " * 30)]
    df = spark.createDataFrame(rows, "qa_id string, text string")
    first = chunking.chunk_documents(df, size=4, overlap=2).orderBy("chunk_id").collect()
    again = chunking.chunk_documents(df.repartition(3), size=4, overlap=2).orderBy("chunk_id").collect()
    assert first == again
    assert {r["qa_id"] for r in first} == {"a", "d"}
    assert [r["chunk_id"] for r in first if r["qa_id"] == "a"] == ["a#0", "a#1"]


def test_corpus_to_chunks_flattens_metadata(spark):
    df = spark.createDataFrame(
        [("1", "word " * 20, 17, None, 3, "S", None, "sub", " M ", ["a", "b"]), ("2", "short", 1, 1, 1, "S", "d", "s", "m", [])],
        "id string, full_text string, lok_no int, session_no int, ques_no int, type string, date string, subject string, "
        "ministry string, members array<string>")
    row = chunking.corpus_to_chunks(df).collect()
    assert len(row) == 1
    assert row[0]["members"] == "a, b" and row[0]["session_no"] == "" and row[0]["ministry"] == " M " and row[0]["lok_no"] == "17"


def test_half_indexed_documents_are_completed_by_chunk(spark):
    chunks = spark.createDataFrame([("a#0", "a"), ("a#1", "a"), ("b#0", "b")], "chunk_id string, qa_id string")
    indexed = spark.createDataFrame([("a#0", "a")], "chunk_id string, qa_id string")
    ids = lambda df: sorted(r["chunk_id"] for r in df.collect())
    assert ids(incremental.unindexed_chunks(chunks, indexed)) == ["a#1", "b#0"]
    assert ids(incremental.unindexed_chunks(chunks, indexed, granularity="document")) == ["b#0"]
    assert incremental.run_counts(chunks, indexed.union(indexed)).first().asDict() == {"total": 3, "skipped": 1, "new": 2}
