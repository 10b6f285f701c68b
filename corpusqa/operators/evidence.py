"""Profiles as text, evidence packets, and source lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx

# Headings and sentences of the reference's text layouts.
MEMBER_HEAD = "=== MP STATISTICS ==="
MEMBER_NAME = "MP Name: %s"
MEMBER_TOTAL = "Total questions asked: %d"
MEMBER_TOP = "Top Ministries:"
MEMBER_NOTE = (
    "NOTE: Statistics cover ALL questions by this MP, including those "
    "whose full text may not appear in the retrieved chunks."
)
MEMBER_TAIL = "=== END MP STATISTICS ==="
MINISTRY_HEAD = "=== MINISTRY STATISTICS ==="
MINISTRY_NAME = "Ministry: %s"
MINISTRY_TOTAL = "Total questions received: %d"
MINISTRY_TOP = "Top MPs asking this ministry:"
MINISTRY_NOTE = (
    "NOTE: Statistics cover ALL questions to this ministry, including those "
    "whose full text may not appear in the retrieved chunks."
)
MINISTRY_TAIL = "=== END MINISTRY STATISTICS ==="
OVERLAP_HEAD = "=== OVERLAP: %s × %s ==="
OVERLAP_TOTAL = "Questions from this MP to this Ministry: %d"
OVERLAP_TAIL = "=== END OVERLAP ==="
BY_LOK = "By Lok Sabha:"
BY_SESSION = "By Session:"
BY_TYPE = "By Type:"
LOK_LINE = "  Lok %d: %d"
COUNT_LINE = "  %s: %d"
TOP_LINE = "  %4d  %s"
QUESTION_HEAD = "Recent Questions (%d):"
QUESTION_LINE = "  %d. [Lok %d, Session %d, Q%d, %s] %s — %s (%s)"
NO_DATE = "N/A"
NO_VALUE = "None"


def _shown(col) -> Column:
    """A null prints as the source language prints it."""
    return F.coalesce(col, F.lit(NO_VALUE))


def _count_lines(counts, pattern=COUNT_LINE):
    def line(e):
        key = e["key"] if pattern == LOK_LINE else _shown(e["key"])
        return F.format_string(pattern, key, e["count"])
    return F.transform(counts, line)


def _top_lines(top):
    return F.transform(top, lambda e: F.format_string(TOP_LINE, e["count"], _shown(e["key"])))


def question_lines(recent) -> Column:
    """Heading, numbered questions and a blank line; nothing for an empty list."""
    def line(q, i):
        return F.format_string(
            QUESTION_LINE, i + 1, q["lok_no"], q["session_no"], q["ques_no"], _shown(q["type"]),
            _shown(q["ministry"]), q["subject"],
            F.coalesce(F.nullif(q["date"], F.lit("")), F.lit(NO_DATE)),
        )

    listed = F.concat(
        F.array(F.format_string(QUESTION_HEAD, F.size(recent))), F.transform(recent, line), F.array(F.lit(""))
    )
    return F.when(F.size(recent) > 0, listed).otherwise(F.array().cast("array<string>"))


def question_list_text(recent) -> Column:
    return F.array_join(question_lines(recent), "\n")


def _block(*parts):
    """Join literal lines and arrays of lines with line breaks."""
    arrays = [F.array(F.lit(p)) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.concat(*arrays), "\n")


def _line(pattern, *cols):
    return F.array(F.format_string(pattern, *cols))


def _fields(src):
    """Fields of a profile row, or of a profile held in the struct column `src`."""
    return F.col if src is None else lambda name: F.col(f"{src}.{name}")


def _first(recent, n):
    return recent if n is None else F.slice(recent, 1, n)


def member_text(n=None, src=None) -> Column:
    """Text of a member profile, with the `n` newest questions or all it holds."""
    c = _fields(src)
    return _block(
        MEMBER_HEAD, _line(MEMBER_NAME, c("mp_name")), _line(MEMBER_TOTAL, c("total_questions")), "",
        BY_LOK, _count_lines(c("by_lok"), LOK_LINE), "",
        BY_SESSION, _count_lines(c("by_session")), "",
        BY_TYPE, _count_lines(c("by_type")), "",
        MEMBER_TOP, _top_lines(c("by_ministry")), "",
        question_lines(_first(c("recent"), n)), MEMBER_NOTE, MEMBER_TAIL,
    )


def ministry_text(n=None, src=None) -> Column:
    """Text of a ministry profile; it has no session block."""
    c = _fields(src)
    return _block(
        MINISTRY_HEAD, _line(MINISTRY_NAME, c("ministry")), _line(MINISTRY_TOTAL, c("total_questions")), "",
        BY_LOK, _count_lines(c("by_lok"), LOK_LINE), "",
        BY_TYPE, _count_lines(c("by_type")), "",
        MINISTRY_TOP, _top_lines(c("top_mps")), "",
        question_lines(_first(c("recent"), n)), MINISTRY_NOTE, MINISTRY_TAIL,
    )


def overlap_text(n=None, src=None) -> Column:
    c = _fields(src)
    types = F.array_join(
        F.transform(c("by_type"), lambda e: F.format_string("%s: %d", _shown(e["key"]), e["count"])), ", "
    )
    return _block(
        _line(OVERLAP_HEAD, c("mp_name"), c("ministry")), _line(OVERLAP_TOTAL, c("total_questions")),
        F.array(F.concat(F.lit(BY_TYPE + " "), types)), "",
        question_lines(_first(c("recent"), n)), OVERLAP_TAIL,
    )


def evidence_packets(
    requests: DataFrame, members: DataFrame, ministries: DataFrame, overlaps: DataFrame,
    *, top_q=schemas.TOP_QUESTIONS,
) -> DataFrame:
    """Add `evidence` to requests with columns `mp` and `ministry`, either may be null.

    The profiles must hold at least `top_q` recent questions. With both
    filters the pair comes first in full, then member and ministry with half
    as many questions, three at least. Text is built after the joins and once
    per distinct filter pair: profiles nobody asked for are never rendered,
    and a popular filter does not repeat the work.
    """
    mp, wanted = F.nullif(F.col("mp"), F.lit("")), F.nullif(F.col("ministry"), F.lit(""))
    pairs = requests.select(mp.alias("_mp"), wanted.alias("_min")).distinct()
    member = members.select(F.col("mp_name").alias("_mp"), F.struct("*").alias("_m"))
    ministry = ministries.select(F.col("ministry").alias("_min"), F.struct("*").alias("_d"))
    overlap = overlaps.select(
        F.col("mp_name").alias("_mp"), F.col("ministry").alias("_min"), F.struct("*").alias("_o")
    )

    both = F.col("_mp").isNotNull() & F.col("_min").isNotNull()
    shown = F.when(both, F.lit(max(top_q // 2, 3))).otherwise(F.lit(top_q))
    sections = F.array_compact(F.array(
        F.when(F.col("_o").isNotNull(), overlap_text(top_q, "_o")),
        F.when(F.col("_m").isNotNull(), member_text(shown, "_m")),
        F.when(F.col("_d").isNotNull(), ministry_text(shown, "_d")),
    ))
    packets = (
        pairs.join(overlap, ["_mp", "_min"], "left").join(member, "_mp", "left").join(ministry, "_min", "left")
        .select("_mp", "_min", F.nullif(F.array_join(sections, "\n\n"), F.lit("")).alias("evidence"))
    )
    return (
        requests.withColumns({"_mp0": mp, "_min0": wanted})
        .join(packets, F.col("_mp0").eqNullSafe(F.col("_mp")) & F.col("_min0").eqNullSafe(F.col("_min")), "left")
        .drop("_mp0", "_min0", "_mp", "_min")
    )


def source_rows(retrieved: DataFrame) -> DataFrame:
    """Display rows: rank, id, score to three decimals, ministry, subject, excerpt."""
    return retrieved.select(
        "query_id", "rank", "qa_id",
        F.when(F.col("score").isNull(), F.lit("n/a"))
        .otherwise(tx.fixed("score", 3)).alias("score_text"),
        F.coalesce("ministry", F.lit("")).alias("ministry"),
        F.coalesce("subject", F.lit("unknown")).alias("subject"),
        # The layout shows the first 200 characters.
        F.concat(tx.strip(F.substring("text", 1, 200)), F.lit("...")).alias("excerpt"),
    )
