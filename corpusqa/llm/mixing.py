"""Mixing sources to target weights by capped water-filling.

Sources share a number of words by their weights, but none takes more than
`MAX_EPOCHS` times its own words: sources above are set to that cap and what is
left is shared among the others by weight, again and again, until none is above.
A source with a target of, say, 1.3 times its words takes every document once and
a seeded sample of documents once more, which makes up 0.3 of its words.

Only aggregates move: sums per source, sums per source and range of the seeded
numbers, and the documents of the one range per source where the sample ends. A
source that holds a third of all rows is summed map-side and sampled by its
numbers; its rows are never gathered. A round of water-filling brings two sums to
the driver. All is DataFrame code.

Defined results: a null text has size 0. The null source is a source of its own,
after all others. Rows with equal keys have equal seeded numbers and are sampled
together. The sample ends at the number where its words come nearest to the
target. Sources without words, and empty tables, take nothing. Other columns stay
as they are.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_and_read

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 11
# Seeded numbers have 60 bits; the ranges that are summed first share the upper twelve.
RANGE_BITS = 48


def word_count(text: Column) -> Column:
    """Words separated by ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_number(key: Column, seed=SEED) -> Column:
    """A number of 60 bits that depends on the key and the seed alone."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def in_order(df: DataFrame, order, name) -> DataFrame:
    """Number the rows of `df` from 0 by one sorting column, without gathering them."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    ranged = write_and_read(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(offsets, "_part").withColumn(name, place).drop("_at", "_part", "_before")


def water_level(sources: DataFrame, words) -> float:
    """The words per unit of weight at which all targets add up to `words`."""
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("fixed"),
            F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("weights"),
        ).first()
        if not row["weights"]:
            return float("inf")
        raised = (words - row["fixed"]) / row["weights"]
        if raised <= level:
            return level
        level = raised


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, epochs=MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from a stored table with source and size."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = in_order(sources, F.asc_nulls_last("source"), "_place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size"))
    sources = write_and_read(sources.drop("_place"), "sources")
    words = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sources, words)
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    # With nothing to share the level is infinite or zero, and so is no target.
    return sources.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def sampling_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Add to each source how often all its documents are taken, and up to which number once more.

    `sized` has source, size and number; both tables are stored.
    """
    whole = F.floor(F.col("target") / F.col("source_size"))
    plan = targets.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long"))
    plan = write_and_read(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "plan")
    rest = plan.select(F.col("source").alias("_source"), "rest")

    ranges = sized.groupBy("source", F.shiftright("number", RANGE_BITS).alias("range")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ranges = ranges.join(rest, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranges = write_and_read(ranges, "ranges")
    # All of a range is taken, none, or, in one range of a source, a part.
    taken = ranges.where(F.col("before") + F.col("words") <= F.col("rest"))
    ends = ranges.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    ends = ends.select(F.col("source").alias("_source"), F.col("range").alias("_range"), "before", "rest")
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("number", RANGE_BITS) == F.col("_range"))
    inside = sized.join(ends, on).groupBy("source", "_range", "before", "rest", "number").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source", "_range").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("words").over(order), F.lit(0))
    inside = inside.withColumn("start", start).where(2 * F.col("start") + F.col("words") <= 2 * F.col("rest"))
    limits = taken.select("source", (F.shiftleft(F.col("range") + 1, RANGE_BITS) - 1).alias("limit")).unionByName(
        inside.select("source", F.col("number").alias("limit")))
    limits = limits.groupBy(F.col("source").alias("_source")).agg(F.max("limit").alias("limit"))
    joined = plan.join(limits, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "rest")
    # Stored, so that its size is known where it is joined to documents.
    return write_and_read(joined.withColumn("limit", F.coalesce("limit", F.lit(-1))), "plan")


def copies(plan_whole="whole", plan_limit="limit", number="number") -> Column:
    """How often a document is taken."""
    return F.col(plan_whole) + (F.col(number) <= F.col(plan_limit)).cast("long")


def _sized(docs: DataFrame, seed) -> DataFrame:
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return write_and_read(sizes.withColumn("number", seeded_number(F.col("doc_id"), seed)), "sizes")


def mix_table(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken."""
    sized = _sized(docs, seed)
    plan = sampling_plan(sized, source_targets(sized, weights, share, epochs)).withColumnRenamed("source", "_source")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    sized = _sized(docs, seed)
    plan = sampling_plan(sized, source_targets(sized, weights, share, epochs))
    plan = plan.select(F.col("source").alias("corpusqa source"), F.col("whole").alias("corpusqa whole"), F.col("limit").alias("corpusqa limit"))
    numbered = docs.withColumn("corpusqa number", seeded_number(F.col("doc_id"), seed))
    joined = numbered.join(plan, F.col("source").eqNullSafe(F.col("corpusqa source")))
    times = copies("corpusqa whole", "corpusqa limit", "corpusqa number")
    joined = joined.withColumn("corpusqa times", times).where(F.col("corpusqa times") > 0)
    return joined.withColumn("corpusqa copy", F.explode(F.sequence(F.lit(1), F.col("corpusqa times").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
