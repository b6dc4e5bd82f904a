"""Connected components by alternating large-star and small-star steps, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import shared


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (a, b) with m, the least of a's neighbours.  Hubs are split: see join_counted."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return shared.join_counted(edges, least, "a", "n", total)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """For edges (a, b) of longs: (node, root) of every node but the roots, where root is the least node of its
    component.  Self edges and repeated edges do no harm.  Each round is written to the shared folder; rounds end when
    nothing changes."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = shared.keep(e, name)

    def state(x):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(e)
    while now[0]:
        # large star: the greater neighbours of a node go to its least neighbour (or to itself)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * now[0]).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        large = shared.keep(large, name)
        # small star: the lesser neighbours of a node, and the node, go to the least of them
        linked = _with_least(large, large.count())
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b")))
        e = shared.keep(small.filter("a <> b").distinct(), name)
        before, now = now, state(e)
        if before == now:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
