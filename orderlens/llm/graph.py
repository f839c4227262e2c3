"""Connected components of links, as joins and aggregations over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that is reachable.

    Each round points every node at its smallest neighbour, follows pointers twice, and contracts the links;
    what is left falls at least by half, and to nothing in a round or two for star-shaped links. Neighbours
    are aggregated before the shuffle, so a node of very many links is no burden; every round ends in a table.
    """
    links = common.table(links.select("a", "b").filter("a <> b").distinct(), "links")
    both = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    roots = common.table(both.withColumn("root", F.col("node")), "roots")
    while not links.isEmpty():
        ways = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = common.table(ways.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("p")).select("n", F.least("n", "p").alias("p")), "up")
        for _ in range(2):
            over = common.bounded_broadcast(up.select(F.col("n").alias("p"), F.col("p").alias("q")))
            up = common.table(up.join(over, "p", "left").select("n", F.coalesce("q", "p").alias("p")), "up")
        up = common.bounded_broadcast(up)
        move = lambda df, c: df.join(up.select(F.col("n").alias(c), "p"), c, "left").withColumn(c, F.coalesce("p", c)).drop("p")  # noqa: E731, B023
        roots = common.table(move(roots, "root").select("node", "root"), "roots")
        links = common.table(move(move(links, "a"), "b").select("a", "b").filter("a <> b").distinct(), "links")
    return roots
