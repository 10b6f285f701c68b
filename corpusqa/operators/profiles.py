"""Profiles per member, per ministry and per pair, for all keys at once.

Every breakdown counts at the finest grain it needs and rolls up from there. A
key that holds a large share of the rows is spread over many groups, which are
combined map-side before any shuffle. The questions-to-members join feeds
several breakdowns; where it is large, pass it as a stored table.

Of many keys a task combines little and holds what it reads, and Spark sizes
tasks by compressed bytes, of which names and counts need few. Where `parts` is
given, rows go to that many tasks first, so that each holds a bounded number.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx

# Rows of the join for one task to count or sort.
ROWS_PER_TASK = 200_000
# Tasks that share the rows of one key before these are combined.
SHARES = 8


def parts_of(stored: DataFrame) -> int:
    """Number of tasks for a stored table; its rows are counted in the footers of its files."""
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // ROWS_PER_TASK))


def _spread(rows: DataFrame, parts, *cols) -> DataFrame:
    return rows if parts is None else rows.repartition(parts, *cols)


def _share():
    return F.pmod(F.xxhash64("ques_no"), F.lit(SHARES))


def newest_first():
    """Newest first; the columns after `ques_no` only settle ties."""
    return [F.desc_nulls_last("date"), F.desc("ques_no"), F.asc("lok_no"), F.asc("session_no"), F.asc("type")]


def fine_counts(rows: DataFrame, keys, *, parts=None) -> DataFrame:
    """Row counts per key, term, session and type."""
    cell = [*keys, "lok_no", "session_no", "type"]
    return _spread(rows.select(*cell), parts, *cell).groupBy(*cell).agg(F.count("*").alias("n"))


def breakdowns(fine: DataFrame, keys, *, parts=None) -> DataFrame:
    """Totals and ordered counts by term, session label and type.

    Term and type sort ascending; session labels sort as text. With `parts`, the
    fine counts of a key meet in one task, and nothing is shuffled after that.
    """
    fine = _spread(fine, parts, *keys)
    entries = F.array(
        F.struct(F.lit("lok").alias("kind"), F.col("lok_no").alias("lok"), F.lit(None).cast("string").alias("key")),
        F.struct(F.lit("session").alias("kind"), F.lit(None).cast("int").alias("lok"), tx.session_label().alias("key")),
        F.struct(F.lit("type").alias("kind"), F.lit(None).cast("int").alias("lok"), F.col("type").alias("key")),
    )
    counted = (
        fine.select(*keys, "n", F.explode(entries).alias("e"))
        .groupBy(*keys, "e.kind", "e.lok", "e.key")
        .agg(F.sum("n").alias("count"))
    )

    def ordered(kind, key):
        return F.array_sort(F.collect_list(
            F.when(F.col("kind") == kind, F.struct(F.col(key).alias("key"), "count"))
        ))

    return counted.groupBy(*keys).agg(
        F.sum(F.when(F.col("kind") == "lok", F.col("count"))).alias("total_questions"),
        ordered("lok", "lok").alias("by_lok"),
        ordered("session", "key").alias("by_session"),
        ordered("type", "key").alias("by_type"),
    )


def top_categories(rows: DataFrame, keys, by, *, n=schemas.TOP_CATEGORIES, tie="latest", parts=None) -> DataFrame:
    """The `n` most frequent values of `by` per key, as `(rank, key, count)` rows.

    With `tie="latest"` equal counts keep the order in which the values first
    appear among the newest questions, else they sort by name.
    """
    measures = [F.count("*").alias("count")]
    order = [F.desc("count")]
    if tie == "latest":
        measures.append(F.max(F.struct("date", "ques_no")).alias("latest"))
        order.append(F.desc("latest"))
    window = Window.partitionBy(*keys).orderBy(*order, F.asc("key"))
    rows = _spread(rows.select(*keys, by, "date", "ques_no"), parts, *keys, by, _share())
    return (
        rows.groupBy(*keys, F.col(by).alias("key")).agg(*measures)
        .withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= n)
        .select(*keys, "rank", "key", "count")
    )


def recent_questions(rows: DataFrame, keys, *, n=schemas.TOP_QUESTIONS, parts=None) -> DataFrame:
    """The `n` newest questions per key. The rank limit also runs before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*newest_first())
    subject = tx.strip(F.coalesce(F.col("subject"), F.lit("")))
    columns = ["lok_no", "session_no", "ques_no", "type", "date"]
    return (
        _spread(rows, parts, *keys, _share()).withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= n)
        .select(*dict.fromkeys([*keys, "rank", *columns, "ministry"]), subject.alias("subject"))
    )


def _fold(ranked, keys, fields, out):
    """Collect ranked rows (a bounded number per key) into an array in rank order."""
    entry = F.struct("rank", *fields)
    return ranked.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct(*[e[f].alias(f) for f in fields]),
        ).alias(out)
    )


RECENT_FIELDS = ["lok_no", "session_no", "ques_no", "type", "date", "ministry", "subject"]


def _fold_recent(recent, keys):
    # `ministry` may be a key, so the entry takes it from a copy.
    copy = recent.withColumn("_m", F.col("ministry"))
    fields = [F.col("_m").alias("ministry") if f == "ministry" else F.col(f) for f in RECENT_FIELDS]
    entry = F.struct("rank", F.struct(*fields).alias("question"))
    return copy.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["question"]).alias("recent")
    )


def member_profiles(
    asked: DataFrame, *, top_q=schemas.TOP_QUESTIONS, top_n=schemas.TOP_CATEGORIES, parts=None
) -> DataFrame:
    """One row per member from the questions-to-members join.

    Duplicate links count twice, in the total as in every breakdown.
    """
    keys = ["mp_name"]
    top = _fold(top_categories(asked, keys, "ministry", n=top_n, parts=parts), keys, ["key", "count"], "by_ministry")
    recent = _fold_recent(recent_questions(asked, keys, n=top_q, parts=parts), keys)
    return breakdowns(fine_counts(asked, keys, parts=parts), keys, parts=parts).join(top, keys).join(recent, keys)


def ministry_profiles(
    questions: DataFrame, asked: DataFrame, *, top_q=schemas.TOP_QUESTIONS, top_n=schemas.TOP_CATEGORIES
) -> DataFrame:
    """One row per ministry. Counts use `questions`; only the members use the join."""
    keys = ["ministry"]
    named = questions.where(F.col("ministry").isNotNull())
    links = asked.where(F.col("ministry").isNotNull())
    top = _fold(top_categories(links, keys, "mp_name", n=top_n, tie="name"), keys, ["key", "count"], "top_mps")
    recent = _fold_recent(recent_questions(named, keys, n=top_q), keys)
    none = F.array().cast("array<struct<key:string,count:bigint>>")
    return (
        breakdowns(fine_counts(named, keys), keys)
        .join(top, keys, "left")
        .withColumn("top_mps", F.coalesce("top_mps", none))
        .join(recent, keys)
    )


def overlap_profiles(asked: DataFrame, *, top_q=schemas.TOP_QUESTIONS, parts=None) -> DataFrame:
    """One row per (member, ministry) that occurs."""
    keys = ["mp_name", "ministry"]
    named = asked.where(F.col("ministry").isNotNull())
    recent = _fold_recent(recent_questions(named, keys, n=top_q, parts=parts), keys)
    counts = breakdowns(fine_counts(named, keys, parts=parts), keys, parts=parts)
    counts = counts.select(*keys, "total_questions", "by_type")
    return counts.join(recent, keys)
