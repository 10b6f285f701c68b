"""Quality by a sparse ensemble of rules.

Statistics of every text are taken in one pass: shares of kinds of characters,
lengths of words and lines, repetition. Shallow trees are grown on labelled rows,
and each path from a root becomes a rule, a conjunction of comparisons. A logistic
model with a lasso penalty gives most rules no weight; the others are compiled
into one Spark column over the statistics, which scores the whole table.

Trees and weights are learned from at most about `MAX_LABELLED` labelled rows of
each class, chosen by a hash of the key, or all where there are fewer. Statistics
are taken of all rows and whole texts, and only they enter a score.

Defined results: null and empty texts have statistics of zero and a score like any
other. Without rows to learn from every score is 0.5, with rows of one class only
it is that class. Of several labels of one key the largest counts; null keys and
labels teach nothing. Repeated rows each get their score. Empty tables give no
rows. Columns of the input that are not asked for are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import write_and_read
from .labels import held_out, teaching_labels
from .words import slices, text_bytes, words_of

FOLDS, HELD_OUT = 5, 0
MAX_LABELLED = 50_000
TREES, DEPTH = 16, 3
LASSO = 0.001
THRESHOLD = 0.3

# Kinds of bytes that are counted, as shares of the text.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".", "comma": b",",
    "mark": b"!?", "bar": b"|", "symbol": b"#$%&*+<=>@[]^_{}~\\", "line": b"\n", "blank": b" \t\x0b\x0c\r",
}
STATISTICS = [
    "log_bytes", "log_words", *(f"{kind}_share" for kind in KINDS), "wide_share", "word_bytes",
    "distinct_share", "top_share", "again_share", "line_words",
]


def _statistics(array):
    """One column per statistic for the texts of an Arrow array."""
    data, offsets = text_bytes(array)
    size = np.diff(offsets).astype(float)

    def per_text(flags):
        total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    counts = {}
    for kind, chars in KINDS.items():
        table = np.zeros(256, dtype=bool)
        table[list(chars)] = True
        counts[kind] = per_text(table[data])
    whole = np.maximum(size, 1)
    out = {f"{kind}_share": counts[kind] / whole for kind in KINDS}
    out["wide_share"] = per_text(data >= 128) / whole

    found = words_of(array)
    words = np.diff(found.bounds).astype(float)
    some = np.maximum(words, 1)
    texts = found.text_of()
    order = np.lexsort((found.hashes, texts))
    owner, value = texts[order], found.hashes[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    starts = np.nonzero(fresh)[0]
    runs = np.diff(np.r_[starts, len(order)])
    top = np.zeros(len(size))
    np.maximum.at(top, owner[starts], runs)
    again = (found.hashes[1:] == found.hashes[:-1]) & (texts[1:] == texts[:-1])
    out["distinct_share"] = np.bincount(owner[starts], minlength=len(size)) / some
    out["top_share"] = top / some
    out["again_share"] = np.bincount(texts[1:][again], minlength=len(size)) / some
    out["word_bytes"] = (size - counts["blank"] - counts["line"]) / some
    out["line_words"] = np.log1p(words / (1 + counts["line"]))
    out["log_bytes"], out["log_words"] = np.log1p(size), np.log1p(words)
    return [out[name] for name in STATISTICS]


def with_statistics(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(key, statistics) of every row."""
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                columns = [pa.array(c, type=pa.float64()) for c in _statistics(part.column("_text"))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *columns], schema=arrow)

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, out)


def tree_rules(forest):
    """Paths of a forest as rules: sets of (statistic, at most?, threshold)."""
    rules = {}

    def walk(node, path):
        if path:
            # The narrowest bound of each kind is enough.
            bounds = {}
            for name, at_most, limit in path:
                old = bounds.get((name, at_most))
                bounds[name, at_most] = limit if old is None else (min if at_most else max)(old, limit)
            rules.setdefault(tuple(sorted((n, side, limit) for (n, side), limit in bounds.items())))
        if node.getClass().getSimpleName() != "LeafNode":
            split = node.split()
            name, limit = STATISTICS[split.featureIndex()], split.threshold()
            walk(node.leftChild(), [*path, (name, True, limit)])
            walk(node.rightChild(), [*path, (name, False, limit)])

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), [])
    return list(rules)


def rule_column(rule):
    """A rule as a Spark column: 1 where all its comparisons hold."""
    holds = F.lit(True)
    for name, at_most, limit in rule:
        holds = holds & (F.col(name) <= F.lit(limit) if at_most else F.col(name) > F.lit(limit))
    return holds.cast("double")


def fit_rules(rows: DataFrame, seed=7):
    """(intercept, {rule: weight}) from rows of statistics and a label."""
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows)
    forest = RandomForestClassifier(
        labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, seed=seed).fit(vectors.select("features", "label"))
    rules = tree_rules(forest)
    if not rules:
        return None
    names = [f"r{i}" for i in range(len(rules))]
    flags = rows.select("label", *(rule_column(rule).alias(n) for rule, n in zip(rules, names)))
    flags = VectorAssembler(inputCols=names, outputCol="features").transform(flags).select("features", "label")
    model = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(flags)
    weights = {rule: float(w) for rule, w in zip(rules, model.coefficients.toArray()) if w}
    return float(model.intercept), weights


def compiled(model):
    """The model as one Spark column between 0 and 1."""
    intercept, weights = model
    total = F.lit(intercept)
    for rule, weight in sorted(weights.items()):
        total = total + F.lit(weight) * rule_column(rule)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(statistics: DataFrame, labels: DataFrame, label="quality", key="doc_id"):
    """The score as a column over a stored table of statistics."""
    chosen = F.broadcast(teaching_labels(labels, label, key, FOLDS, HELD_OUT, MAX_LABELLED))
    rows = write_and_read(statistics.join(chosen, key).select("label", *STATISTICS), "labelled")
    classes = sorted(r[0] for r in rows.select("label").distinct().collect())
    if len(classes) < 2:
        return F.lit(float(classes[0]) if classes else 0.5)
    model = fit_rules(rows)
    share = rows.agg(F.avg("label")).first()[0]
    return compiled(model) if model else F.lit(float(share))


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: whether it is held out, its score, and the prediction."""
    statistics = write_and_read(with_statistics(docs), "statistics")
    scored = statistics.withColumn("score", train(statistics, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
