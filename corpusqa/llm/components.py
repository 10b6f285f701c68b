"""Connected components of a table of links.

Each round hooks every node to the neighbour with the smallest number, or to none if
its own is smallest, follows two hooks, and goes on with the links that still join
different nodes. Numbers are hashes drawn anew in every round: whatever the names of
the nodes and the shape of the links, a round leaves a part of the nodes that is on
average below two thirds, so rounds grow with the logarithm of the largest component.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_and_read


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b), both long; equal roots where connected."""
    maps = []
    links = write_and_read(links.where("a <> b").distinct(), "links")
    while not links.isEmpty():
        def place(node):
            return F.struct(F.xxhash64(F.lit(len(maps)), node).alias("at"), node.alias("node"))

        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(place(F.col("b"))).alias("best"))
        hook = write_and_read(hook.select("a", F.least(place(F.col("a")), "best")["node"].alias("to")), "hooks")
        second = hook.select(F.col("a").alias("to"), F.col("to").alias("root"))
        step = write_and_read(hook.join(second, "to").select(F.col("a").alias("node"), "root"), "roots")
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(left, "a").join(right, "b").where("ra <> rb")
        links = write_and_read(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for step in maps[1:]:
        then = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = write_and_read(out.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
    return out
