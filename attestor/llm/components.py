"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.session import Workspace

MAX_ROUNDS = 60


def _hook(pairs: DataFrame, only_up: bool, work: Workspace) -> DataFrame:
    """Links of every node's neighbours to its smallest neighbour (itself included).

    The minima are written before the join, so that both its sides are plain exchanges, which adaptive execution splits.
    """
    least = work.save(pairs.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("k"), F.least("u", "least").alias("m")), "least")
    met = pairs.join(least, pairs.u == least.k)
    keep = F.col("v") > F.col("u") if only_up else F.col("v") != F.col("m")
    return met.where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame, src: str, dst: str, work: Workspace) -> DataFrame:
    """(node, root) for every node of at least one link between two different nodes; root is the smallest node reachable.

    Alternates large-star and small-star steps over the table of links. Each step is a minimum per node,
    pre-aggregated before its shuffle, and a join that adaptive execution splits where a node is hot;
    links and labels stay distributed, and each round ends in a table of the shared folder. Null ends and
    loops are no links; repeated links count once; no links give an empty table.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a != b")
    now = work.save(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = work.save(_hook(both, True, work).where("a != b").distinct(), "large")
        work.drop(now)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _hook(down, False, work).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = work.save(small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small")
        work.drop(large)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
