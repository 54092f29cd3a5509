"""Connected components by alternating large-star and small-star joins.

Every round is two joins over the edge list, with minima taken by a
partially aggregated groupBy, so that a node with very many links costs one
row per map task, and the join back to its links may be split by the
adaptive skew join. Rounds are written to the shared folder; neither edges
nor labels reach the driver, only one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.plans.shared import materialise, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label the nodes of an undirected edge list (u, v) with their component's least node.

    Returns (node, component), one row per node that has an edge. Null ends
    and self-links are left out, repeated and reversed edges count once, and
    an empty edge list gives an empty result. Raises if max_rounds, far above
    the squared logarithm of any edge count, is not enough.
    """
    pairs = edges.select("u", "v").where("u <> v")
    now = materialise(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        nxt = materialise(_small_star(_large_star(now).distinct()).distinct(), "cc")
        new = _mark(nxt)
        release(now)
        now, done = nxt, new == mark
        mark = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
