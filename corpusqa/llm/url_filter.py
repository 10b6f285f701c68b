"""URL rules by a sort-merge range join.

A host is turned around label by label, `a.example.org` into `org.example.a.`,
so that a rule's host and all its subdomains are one interval of sorted keys.
Addresses and rules are sorted together; a sweep over a sorted run keeps the
stack of rules whose interval holds the current key, outermost first, and tests
the paths of the stack against the path of each address.

The sorted keys are cut into runs at boundaries taken from a sample of the
addresses (a documented number per run, as any range partitioning does). The
sort key goes on with the path and a number of the row after the host, so one
host, or one address, that holds a third of all rows is cut into many runs. A
rule goes to every run that its interval touches, at most one copy for each
rule that is open at a boundary besides the rule itself.

Defined results: a null address, or one without `://`, has an empty host and
path and fits no rule. Of the rules that fit, the one with the longest host and
path in code points wins, then the longer host, then the smaller text, then
`allow`. An address that no rule fits gets `default`. Repeated rows each get
their verdict. Empty tables, and an empty rule list, give what follows from it.
"""

from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Sampled sort keys per run when the boundaries are chosen, and of all runs.
SAMPLES_PER_RUN = 20
MAX_SAMPLES = 1_000_000
# After every key that starts with a given prefix, in byte order.
LAST = "\U0010ffff"


def address_parts(df: DataFrame, url="url") -> DataFrame:
    """Add `host` and `path` of an address column."""
    rest = F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.withColumns({
        "host": F.translate(host, upper, upper.lower()),
        "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1),
    })


def host_key(host):
    """Labels from the last to the first, each with a dot after it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark, rules) -> DataFrame:
    """Rules as a DataFrame from (verdict, host, path) triples."""
    schema = "verdict string, host string, path string"
    return spark.createDataFrame([tuple(r) for r in rules], schema)


def _runs(keys: DataFrame, runs):
    """Boundaries between runs of about equal size, from a sample of sorted keys."""
    wanted, rows = min(runs * SAMPLES_PER_RUN, MAX_SAMPLES), keys.count()
    hashed = keys.select("sort_key").withColumn("hash", F.xxhash64("sort_key").cast("double"))
    # Hashes are spread evenly from -2^63 to 2^63: about `wanted` rows are below the limit.
    sample = hashed.where(F.col("hash") <= F.lit(2.0**64 * (wanted / max(rows, wanted)) - 2.0**63)).select("sort_key")
    found = sorted((row[0] for row in sample.collect()), key=lambda k: k.encode("utf-8", "surrogatepass"))
    cuts = [found[i * len(found) // runs] for i in range(1, runs)] if found else []
    return sorted(set(cuts), key=lambda k: k.encode("utf-8", "surrogatepass"))


def _run_of(column, cuts):
    """Number of the run that holds a key."""
    cuts = [c.encode("utf-8", "surrogatepass") for c in cuts]

    @F.pandas_udf("int")
    def number(keys):
        return pd.Series([bisect_right(cuts, k.encode("utf-8", "surrogatepass")) for k in keys], dtype="int32")

    return number(column)


def judge_urls(pages: DataFrame, rules: DataFrame, key="page_id", url="url", default="allow", runs=None) -> DataFrame:
    """`key`, host, path, the winning rule and the verdict of every row of `pages`.

    `rules` has the columns verdict, host and path.
    """
    spark = pages.sparkSession
    runs = runs or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = address_parts(pages.select(F.col(key).alias("id"), F.col(url).alias("url"))).drop("url")
    rows = rows.withColumn("host_key", host_key(F.col("host")))
    row_number = F.hex(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.monotonically_increasing_id()))
    stable = F.hex(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    at = lambda last: F.concat_ws("\0", F.col("host_key"), F.col("path"), last)
    cuts = _runs(rows.withColumn("sort_key", at(stable)), runs)

    urls = rows.withColumn("sort_key", at(row_number))
    urls = urls.select(
        _run_of(F.col("sort_key"), cuts).alias("run"), F.col("host_key"), F.lit(1).alias("kind"),
        "host", "path", F.lit(None).cast("string").alias("verdict"), "id")
    spans = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).withColumn("host_key", host_key(F.col("host")))
    spans = spans.withColumn("first", _run_of(F.col("host_key"), cuts)).withColumn(
        "last", _run_of(F.concat(F.col("host_key"), F.lit(LAST)), cuts))
    opens = spans.select(
        F.explode(F.sequence("first", "last")).alias("run"), "host_key", F.lit(0).alias("kind"),
        "host", "path", "verdict", F.lit(None).cast(rows.schema["id"].dataType).alias("id"))
    swept = opens.unionByName(urls).repartition("run").sortWithinPartitions("run", "host_key", "kind")

    out = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()),
        T.StructField("verdict", T.StringType()),
    ])
    judged = swept.mapInArrow(_sweep(default, to_arrow_schema(out)), out)
    return judged.withColumnRenamed("id", key)


def _sweep(default, schema):
    """Sweep over rows sorted by run and key, rules before addresses of the same key."""

    def best(stack, path):
        found = None
        for _, paths in stack:
            for rule_path, rank, name, verdict in paths:
                if (found is None or rank > found[0]) and path.startswith(rule_path):
                    found = (rank, name, verdict)
        return found

    def sweep(batches):
        run, stack = None, []
        for batch in batches:
            names, verdicts, keep = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("run", "host_key", "kind", "host", "path", "verdict"))
            for i, (at, key, kind, host, path, verdict) in enumerate(zip(*columns)):
                if at != run:
                    run, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    name = host + path
                    # Longest rule, then longer host, then smaller text, then allow.
                    rank = (len(name), len(host), tuple(-ord(c) for c in name), verdict == "allow")
                    stack[-1][1].append((path, rank, name, verdict))
                    continue
                found = best(stack, path) if host else None
                names.append(found[1] if found else None)
                verdicts.append(found[2] if found else default)
                keep.append(i)
            part = batch.take(pa.array(keep, type=pa.int64()))
            columns = [part.column(c) for c in ("id", "host", "path")]
            columns += [pa.array(names, type=pa.string()), pa.array(verdicts, type=pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return sweep
