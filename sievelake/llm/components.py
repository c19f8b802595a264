"""Connected components of a graph of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, table_mark, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Large-star and small-star steps in turn (MapReduce connected components):
    every node learns the least of its neighbours and passes it on, which
    halves distances, so that rounds grow with the logarithm of the longest
    path. Each round writes its links to the shared folder. The least
    neighbour is an aggregate, and the joins on it can be split by Spark where
    one node has very many links. Stops when the links stay as they were.

    Links of a node to itself, repeated ones and both directions of one change
    nothing; links with a null end are left out; without links there are no rows.
    """
    mark = table_mark()
    links = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = links.union(links.select("b", "a"))
        large = both.join(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "a")
        large = large.filter("b > a and b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.join(down.groupBy("a").agg(F.min("b").alias("least")), "a")
        small = small.select(F.col("b").alias("a"), F.col("least").alias("b")).union(small.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()
        links = written(small, "links")
        drop_tables(links.sparkSession, mark, (links,))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    # Settled links are stars: every node but the smallest has one, to the smallest.
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
