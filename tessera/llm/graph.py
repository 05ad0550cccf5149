"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm.common import hot_keys, spread_join


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of u; the edges of a node that has many are dealt over parts."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return spread_join(edges, least.drop("n"), ["u"], hot_keys(least, ["u"], "n", total), ["v"], "inner")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node hands its larger neighbours the least node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_least(both, 2 * total).where("v > u")
    return near.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down, total)
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = near.select("u", F.col("m").alias("v")).distinct()
    return moved.unionByName(own).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label) of every node in ``edges`` (u, v), a written table; the label is the least node of the component.

    Neighbours are reduced to the least one before they are shuffled, and the edges of a star's centre are dealt over
    parts. Stops when the edges form stars, which takes a number of rounds in the order of the logarithm of the longest
    path.
    """
    mark = None
    with scratch.owner() as made:
        for _ in range(rounds):
            large = scratch.materialize(_large_star(edges, edges.count()), "stars")
            edges = scratch.materialize(_small_star(large, large.count()), "stars")
            made.keep(edges)
            now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == mark:
                break
            mark = now
        else:
            raise RuntimeError(f"links did not settle into stars in {rounds} rounds")
        rows = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        out = scratch.materialize(rows.unionByName(rows.select(F.col("label").alias("node"), "label").distinct()), "labels")
        made.keep(out)
    return out
