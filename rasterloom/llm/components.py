"""Connected components of an edge table, in rounds of minimum hooking that write their edges to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either has one lesser neighbour, and no other, or is the centre of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down > 0 AND up > 0)").limit(1).count() == 0


def connected_components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for each node of edges(a, b); no row for other nodes.

    Alternates large-star and small-star rounds (each node's larger, then lesser, neighbours go to its least neighbour) until
    only stars are left; the number of edges never grows, and hubs are aggregated before they are shuffled.
    Loops are dropped; repeated edges count once; no edges give no rows.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        # a join with a written table has an exchange of its own on either side, so AQE can split a hub's edges over tasks
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = materialize(small.where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError(f"components unsettled after {most_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
