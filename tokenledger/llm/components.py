"""Connected components of an edge table, by alternating star contractions.

Large and small stars tie every node to the smallest node it knows of. The
aggregates combine before their shuffles and are written before the edges are
joined with them: a join that follows an aggregate on its own key would leave a
centre of very many edges to one task, while a join of two tables is split by the
adaptive skew join. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import released, settled


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = _both(edges)
    least = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    tied = settled(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
    released(least)
    return tied


def _small(edges: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them."""
    least = settled(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    tied = settled(moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
    released(least)
    return tied


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or tied to exactly one centre."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("centre")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("centre")))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("up").alias("up"), F.max("centre").alias("centre"))
    return not nodes.filter("up > 1 or (up = 1 and centre = 1)").limit(1).count()


def components(edges: DataFrame, first: str = "a", second: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has an edge to another node.

    ``component`` is the smallest node reachable. Null ends, loops and repeated
    edges count for nothing; an empty table gives an empty result.
    """
    x, y = F.col(f"`{first}`"), F.col(f"`{second}`")
    now = settled(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "edges")
    for _ in range(rounds):
        if _stars(now):
            break
        large = _large(now)
        last, now = now, _small(large)
        released(last, large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    least = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return least.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
