"""Connected components of a link table: hooking onto the smallest neighbour and
pointer doubling, with links redrawn between roots each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import cut, cut_counted, lookup, release


def connected(links: DataFrame) -> DataFrame:
    """(v, label) for every end of `links` (a, b); label is the smallest member.

    Every round at least halves the vertices that still have links. Joins go
    through `lookup`, so a vertex with very many links is split over tasks."""
    edges, state = cut_counted(links.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    m = state["n"]
    label, state = cut_counted(edges.select(F.explode(F.array("u", "v")).alias("v")).distinct().withColumn("label", F.col("v")))
    rows = state["n"]
    while m:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook, state = cut_counted(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")))
        n = state["n"]
        while True:
            jump = lookup(hook.select("u", "p"), hook.select(F.col("u").alias("p"), F.col("p").alias("q")), "p", rows=n).select("u",
                F.col("q").alias("p"), (F.col("p") != F.col("q")).cast("long").alias("moved"))
            step, state = cut_counted(jump, moved=F.sum("moved"))
            release(hook)
            hook = step
            if not state["moved"]:
                break
        old, label = label, cut(lookup(label, hook.select(F.col("u").alias("label"), F.col("p")), "label", "left", rows=rows).select("v",
            F.coalesce("p", "label").alias("label")))
        e = lookup(edges, hook.select("u", F.col("p").alias("x")), "u", rows=m).select("v", "x")
        e = lookup(e, hook.select(F.col("u").alias("v"), F.col("p").alias("y")), "v", rows=m)
        left, state = cut_counted(e.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        release(edges, hook, old)
        edges, m = left, state["n"]
    return label
