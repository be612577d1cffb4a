"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step keeps for every node its smallest neighbour and hangs the other neighbours on it;
the edges end as stars around the smallest node of each component (Kiveris et al., 2014).
Hot nodes meet partial aggregation and joins that adaptive execution splits. Nothing is
collected but one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.work import Scratch


def _with_smallest(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Edges with ``m``, the smallest of ``u`` and its neighbours.

    The minima are written and read back, so that both sides of the join are shuffled for
    it alone and adaptive execution can split a hot node's edges.
    """
    smallest = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(scratch.keep(smallest, name).hint("merge"), "u")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (``u``, ``v``) that is not its
    component's smallest, which is the root."""
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, n, before = scratch.keep(down.distinct(), "edges-0"), 0, None
    while True:
        check = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check == before or check[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, n = check, n + 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = _with_smallest(both, scratch, f"large-min-{n}").where("v > u")
        large = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"large-{n}")
        near = _with_smallest(large, scratch, f"small-min-{n}")
        small = near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(small.where("u <> v").distinct(), f"edges-{n}")
        scratch.drop(f"edges-{n - 1}", f"large-{n}", f"large-min-{n}", f"small-min-{n}")
