"""Connected components of an edge table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import materialise

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component goes by its smallest node.

    In every round each node joins its neighbour of smallest hash (a new order
    each round), edges are renamed and equal ones merge. A constant share of
    the nodes disappears in an average round, whatever the shape, so chains
    need about log n rounds too. Every round is written to the shared folder.
    """
    left = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct()
    left = materialise(left, "edges")
    maps: list[DataFrame] = []
    for k in range(ROUNDS):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        best = both.groupBy("a").agg(F.min(order("b")).alias("m")).withColumn("own", order("a"))
        parent = materialise(best.select(F.col("a").alias("node"), F.when(F.col("m") < F.col("own"), F.col("m.n")).otherwise(F.col("a")).alias("parent")), "parents")
        maps.append(parent)
        renamed = (left.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
                   .join(parent.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b"))
        left = materialise(renamed.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    label = maps[0].select("node", F.col("parent").alias("root"))
    for m in maps[1:]:
        label = (label.join(m.select(F.col("node").alias("root"), F.col("parent").alias("next")), "root", "left")
                 .select("node", F.coalesce("next", "root").alias("root")))
    label = materialise(label, "roots")
    least = label.groupBy("root").agg(F.min("node").alias("component"))
    return materialise(label.join(least, "root").select("node", "component"), "components")
