"""Name resolution and the two relational tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..session import broadcast_within
from .documents import clean_question_fields, explode_members, keyed_questions

KEY = schemas.QUESTION_KEY
# For sorts: Spark compares the first column fast, and the other way round it is the same in most rows.
SORT_KEY = ["ques_no", "session_no", "lok_no", "type"]

# Above this many names the lookup runs as a shuffle join instead.
MAX_BROADCAST_NAMES = 500_000


def canonical_names(registry: DataFrame) -> DataFrame:
    """Map every spelling to the canonical one: `(name, canonical)`.

    The canonical name of a member number is its name in the highest term; in
    one term, the entry listed first. A name under two numbers goes to the
    number that first appears later.
    """
    rows = registry.where((F.col("mpNo") != 0) & (F.col("mpName") != ""))
    numbers = rows.groupBy("mpNo").agg(
        F.max_by("mpName", F.struct(F.col("lok"), -F.col("pos"))).alias("canonical"),
        F.min(F.struct("lok", "pos")).alias("first_seen"),
    )
    return (
        rows.select("mpNo", F.col("mpName").alias("name")).distinct()
        .join(numbers, "mpNo")
        .groupBy("name")
        .agg(F.max_by("canonical", "first_seen").alias("canonical"))
    )


def alias_map(names: DataFrame) -> DataFrame:
    """`(canonical, aliases)`: all spellings of a member, sorted, itself included."""
    return (
        names.groupBy("canonical")
        .agg(F.collect_set("name").alias("spellings"))
        .select(
            "canonical",
            F.array_sort(F.array_union("spellings", F.array("canonical"))).alias("aliases"),
        )
    )


def name_map_summary(names: DataFrame) -> DataFrame:
    """One row: names, names remapped, canonical names, those with several aliases."""
    # A canonical name can have been given to another member, so its alias
    # list also counts the canonical name where no spelling maps to itself.
    per_canonical = names.groupBy("canonical").agg(
        F.count("*").alias("spellings"),
        F.count_if(F.col("name") == F.col("canonical")).alias("own"),
    )
    return per_canonical.agg(
        F.coalesce(F.sum("spellings"), F.lit(0)).alias("names"),
        F.coalesce(F.sum(F.col("spellings") - F.col("own")), F.lit(0)).alias("remapped"),
        F.count("*").alias("canonicals"),
        F.count_if(F.col("spellings") + F.when(F.col("own") == 0, 1).otherwise(0) > 1).alias("multi_alias"),
    )


def all_canonical_names(names: DataFrame) -> DataFrame:
    return names.select(F.col("canonical").alias("name")).distinct().orderBy("name")


def all_ministry_names(ministries: DataFrame, col="minName") -> DataFrame:
    """Distinct stripped names over all terms, renames kept apart, sorted."""
    name = tx.strip(F.col(col)).alias("name")
    return ministries.select(name).where(F.col("name") != "").distinct().orderBy("name")


def latest_questions(corpus: DataFrame, order_cols) -> DataFrame:
    """Upsert by question key: of rows with one key, the last in `order_cols` stays.

    `order_cols` lists sort expressions with the winning row first. Rows with
    a null `type` are all kept, as null never equals null in the key; they go
    round the shuffle. The rank filter is applied before the shuffle too, so a
    key repeated in many rows sends one row per task.
    """
    rows = keyed_questions(corpus)
    window = Window.partitionBy(*SORT_KEY).orderBy(*order_cols)
    winners = (
        rows.where(F.col("type").isNotNull())
        .withColumn("_rank", F.row_number().over(window))
        .where("_rank = 1")
        .drop("_rank")
    )
    return winners.unionByName(rows.where(F.col("type").isNull()))


def build_questions(corpus: DataFrame, order_cols) -> DataFrame:
    """The `questions` table."""
    return questions_of(latest_questions(corpus, order_cols))


def questions_of(latest: DataFrame) -> DataFrame:
    return clean_question_fields(latest).select("lok_no", "session_no", "ques_no", "type", "date", "ministry", "subject")


def _with_canonical(rows, names):
    lookup = broadcast_within(names.withColumnRenamed("name", "mp"), MAX_BROADCAST_NAMES)
    return rows.join(lookup, "mp", "left").withColumn("mp_name", F.coalesce("canonical", "mp"))


def build_links(corpus: DataFrame, names: DataFrame, order_cols) -> DataFrame:
    """The `question_mps` table: who asked each surviving question.

    Repeated names on one question stay repeated.
    """
    return links_of(latest_questions(corpus, order_cols), names)


def links_of(latest: DataFrame, names: DataFrame) -> DataFrame:
    mentions = explode_members(latest.select(*KEY, "members"))
    return _with_canonical(mentions, names).select("lok_no", "session_no", "ques_no", "type", "mp_name")


def build_counts(corpus: DataFrame, names: DataFrame) -> DataFrame:
    """One row: questions, links and renamed links, counted over source rows."""
    rows = keyed_questions(corpus)
    # Counted per name before the lookup, so a frequent name is one row in it.
    mentions = _with_canonical(
        explode_members(rows.select("members"))
        .groupBy("mp").agg(F.count("*").alias("mentions")),
        names,
    )
    links = mentions.agg(
        F.coalesce(F.sum("mentions"), F.lit(0)).alias("links"),
        F.coalesce(F.sum(F.when(F.col("mp_name") != F.col("mp"), F.col("mentions"))), F.lit(0)).alias("renamed"),
    )
    questions = rows.agg(F.count("*").alias("questions"))
    return links.select(
        questions.select("questions").scalar().alias("questions"), "links", "renamed"
    )


def resolve_requests(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add `names`: the alias list of the request's member, or the name itself.

    `names` is null where a request has no member.
    """
    lookup = broadcast_within(aliases.withColumnRenamed("canonical", "mp"), MAX_BROADCAST_NAMES)
    own = F.when(F.col("mp") != "", F.array("mp"))
    return requests.join(lookup, "mp", "left").withColumn("names", F.coalesce("aliases", own)).drop("aliases")


def asked_questions(questions: DataFrame, links: DataFrame) -> DataFrame:
    """Questions joined to who asked them; a null `type` never matches."""
    return questions.join(links, KEY)
