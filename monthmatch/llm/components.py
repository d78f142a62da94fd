"""Connected components of a graph whose edges are spread over a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthmatch.llm.common import saved

#: More rounds than any graph needs that fits a cluster: the number grows with
#: the logarithm of the largest component.
MOST_ROUNDS = 60
#: Edges of a node that a task takes at any rate.
HUB = 200


def _hubs(both: DataFrame, rows: int) -> DataFrame | None:
    """Nodes with more than two fair shares of a partition, with the smallest of them and their neighbours.

    There are fewer of them than partitions, so they come to the driver and go
    out with the tasks. None where there are none, as in most rounds.
    """
    share = 2 * rows // int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    degrees = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    found = degrees.filter(F.col("n") > max(share, HUB)).select("a", "m").collect()
    return both.sparkSession.createDataFrame(found, "a long, m long") if found else None


def _attached(edges: DataFrame, least: DataFrame, of_hubs: DataFrame | None) -> DataFrame:
    """Edges with the ``m`` of their node ``a``; the edges of a hub stay where they are."""
    if of_hubs is None:
        return edges.join(least, "a")
    few = F.broadcast(of_hubs)
    ordinary = edges.join(few, "a", "left_anti").join(least, "a")
    return ordinary.unionByName(edges.join(few, "a"))


def connected(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """For each node (``node``) of an edge (``a``, ``b``) the smallest node it is connected to (``root``).

    Alternating stars: every node's larger neighbours are linked to its smallest
    one, then all its smaller ones, until only stars around the smallest nodes
    remain. The smallest neighbour of a node is a minimum taken before the
    shuffle; edges of nodes that have very many are not shuffled on them. Each
    round is written to ``folder``. Nulls and loops are dropped; no edges give no rows.
    """
    edges = saved(
        edges.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(),
        folder,
        f"{name}-edges",
    )
    before, count = None, edges.count()
    for k in range(MOST_ROUNDS):
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        hubs = _hubs(both, 2 * count)
        # Large star: neighbours above a node move to the smallest around it.
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _attached(both.filter("b > a"), smallest, hubs).selectExpr("b AS a", "m AS b")
        # Small star: a node and what is below it move to the smallest below. A
        # node has no more edges here than before, so there are no other hubs.
        large = large.filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        below = None if hubs is None else (
            large.join(F.broadcast(hubs.select("a")), "a", "left_semi").groupBy("a").agg(F.min("b").alias("m"))
        )
        small = _attached(large, lowest, below).selectExpr("CASE WHEN b = m THEN a ELSE b END AS a", "m AS b")
        edges = saved(small.filter("a <> b").distinct(), folder, f"{name}-{k}")
        # Stars that no round changes any more are the result.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before, count = now, now[0]
    return edges.selectExpr("a AS node", "b AS root").unionByName(
        edges.selectExpr("b AS node", "b AS root").distinct()
    )
