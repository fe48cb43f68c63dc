"""Connected components by alternating stars, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.durable import drop, durable

#: Each round at least halves what is left of a path; more rounds than this mean a fault.
MOST_ROUNDS = 60


def _print(edges: DataFrame) -> tuple[int, int]:
    n, h = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return n, int(h)


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node that an edge (a, b) touches; loops and repeated edges do no harm.

    Large-star joins the larger neighbours of a node to its smallest neighbour, small-star the smaller ones and itself; the edges then form
    stars around the smallest nodes. Minima are tables of their own, so a join on a node with many edges can be split.
    """
    e = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    seen = _print(e)
    for _ in range(MOST_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-large")
        large = durable(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-edges")
        drop(e, least)
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
        down = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        drop(large, least)
        now = _print(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = durable(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "cc-nodes")
    drop(e)
    return nodes
