"""Evidence for a batch of requests straight from the question tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import profiles as pr
from ..operators.evidence import evidence_packets
from ..session import write_and_read


def evidence_for(
    requests: DataFrame, questions: DataFrame, asked: DataFrame, *, top_q=schemas.TOP_QUESTIONS
) -> DataFrame:
    """Add `evidence` to the requests, profiling only what they ask for.

    Rows of other members, ministries and pairs drop out before any counting. The
    rows that stay are stored once: both inputs are read once, whatever number of
    breakdowns follows. The filters are stored too, so that their size decides
    how they are joined. Where stored profiles exist, `evidence_packets` reads
    these instead.
    """
    mp, ministry = F.nullif(F.col("mp"), F.lit("")), F.nullif(F.col("ministry"), F.lit(""))
    filters = write_and_read(requests.select(mp.alias("mp_name"), ministry.alias("ministry")).distinct(), "filters")
    members = filters.select("mp_name").dropna().distinct().withColumn("_by_member", F.lit(True))
    ministries = filters.select("ministry").dropna().distinct().withColumn("_by_ministry", F.lit(True))
    pairs = filters.dropna()

    rows = asked.join(members, "mp_name", "left").join(ministries, "ministry", "left")
    rows = write_and_read(rows.where("_by_member or _by_ministry"), "asked")
    named = write_and_read(questions.join(ministries.select("ministry"), "ministry", "left_semi"), "questions")
    by_member = rows.where("_by_member").drop("_by_member", "_by_ministry")
    by_ministry = rows.where("_by_ministry").drop("_by_member", "_by_ministry")
    parts = pr.parts_of(rows)
    return evidence_packets(
        requests,
        pr.member_profiles(by_member, top_q=top_q, parts=parts),
        pr.ministry_profiles(named, by_ministry, top_q=top_q),
        pr.overlap_profiles(by_member.join(pairs, ["mp_name", "ministry"], "left_semi"), top_q=top_q),
        top_q=top_q,
    )
