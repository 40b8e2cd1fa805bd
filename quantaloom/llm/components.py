"""Connected components of a link table by star contraction, with joins and partial aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaloom.llm._common import cut


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(a, m): the least of a and its neighbours. Written, so that the join with it shuffles both sides and a hub can be split."""
    return cut(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that has a link: root is the least node of its component, itself included.

    ``links`` has two columns of one ordered type. Large and small star alternate: a node's larger, then its smaller
    neighbours are linked to the least neighbour, until nothing changes. No step gathers a node's neighbours in a list.
    """
    a, b = links.columns
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    pairs, before = cut(pairs), None
    while True:
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least_neighbour(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        least = _least_neighbour(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        pairs = cut(small.where("a <> b").distinct())
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return cut(pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots))
