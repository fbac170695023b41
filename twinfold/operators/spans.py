"""Interval joins between spans of files.

A span is joined with another of the same file through the line blocks it covers,
which turns the range condition into an equality; pairs that meet in several
blocks are kept once, in the block where the overlap starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import cut, cut_counted

BLOCK = 256


def _blocks(start: str, end: str) -> Column:
    lo = F.floor(F.col(start) / BLOCK).cast("long")
    return F.explode(F.sequence(lo, F.greatest(F.floor(F.col(end) / BLOCK).cast("long"), lo)))


def overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both have file, start, end (end before start is an empty span and meets
    nothing); other columns must differ in name. Right columns come as r_start, r_end."""
    l = left.filter("end >= start").withColumn("_b", _blocks("start", "end"))
    r = right.filter("end >= start").withColumnsRenamed({"start": "r_start", "end": "r_end"}).withColumn("_b", _blocks("r_start", "r_end"))
    j = l.join(r, ["file", "_b"]).filter("start <= r_end AND r_start <= end")
    return j.filter(F.col("_b") == F.floor(F.greatest("start", "r_start") / BLOCK)).drop("_b")


def members(rows: DataFrame) -> DataFrame:
    return rows.select("family_id", F.posexplode("members").alias("i", "m")).select("family_id", "i", F.col("m.path").alias("file"),
        F.col("m.start_line").alias("start"), F.col("m.end_line").alias("end"))


def divergence(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """(family_id, members, touched): families with members that a changed range
    touches and members that none does."""
    m = members(rows)
    hit = overlap_join(m.filter("file IS NOT NULL"), changed.filter("file IS NOT NULL").distinct()).select("family_id", "i").distinct().withColumn("hit", F.lit(1))
    g = m.select("family_id", "i").join(hit, ["family_id", "i"], "left").groupBy("family_id").agg(F.count(F.lit(1)).alias("members"), F.count("hit").alias("touched"))
    return g.filter("touched > 0 AND touched < members")


def overlapping(rows: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, shared_members): families of which at least `least` members on either
    side overlap one of the other by half of the shorter span or more. Members are
    matched one to one, in their order, each with the first that is still free."""
    m = members(rows).filter("file IS NOT NULL")
    j = overlap_join(m.withColumnRenamed("family_id", "a"), m.withColumnsRenamed({"family_id": "b", "i": "k"})).filter("a < b")
    j = j.filter(2 * (F.least("end", "r_end") - F.greatest("start", "r_start") + 1) >= F.least(F.col("end") - F.col("start"), F.col("r_end") - F.col("r_start")) + 1)
    g = j.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("i", "k"))).alias("m"), F.count_distinct("i").alias("ni"),
        F.count_distinct("k").alias("nk")).filter((F.col("ni") >= least) & (F.col("nk") >= least))
    none = F.expr("cast(array() as array<int>)")
    free = lambda s, x: ~F.array_contains(s["i"], x["i"]) & ~F.array_contains(s["k"], x["k"])
    take = lambda s, x: F.struct(F.concat(s["i"], F.array(x["i"])).alias("i"), F.concat(s["k"], F.array(x["k"])).alias("k"))
    n = F.aggregate("m", F.struct(none.alias("i"), none.alias("k")), lambda s, x: F.when(free(s, x), take(s, x)).otherwise(s), lambda s: F.size(s["i"]))
    return g.select("a", "b", n.alias("shared_members")).filter(F.col("shared_members") >= least)


def without_overlaps(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """(family_id, kept, dropped): per file a member goes if half of it or more lies
    inside one kept before it, longer ones first. Folded inside the family's row."""
    m = F.expr("array_sort(transform(members, m -> struct(-(m.end_line - m.start_line) AS o, m.path AS path, m.start_line AS s, m.end_line AS e)))")
    inside = lambda k, x: (k["path"] == x["path"]) & ((F.least(k["e"], x["e"]) - F.greatest(k["s"], x["s"]) + 1) >= share * (x["e"] - x["s"] + 1))
    empty = F.expr("cast(array() as array<struct<o:int,path:string,s:int,e:int>>)")
    kept = F.aggregate(m, empty, lambda acc, x: F.when(F.exists(acc, lambda k: F.coalesce(inside(k, x), F.lit(False))), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("family_id", F.size(kept).alias("kept"), (F.size("members") - F.size(kept)).alias("dropped"))


def enclosing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """For each inner span (id, file, start, end) the smallest outer span (name)
    that holds it; ties go to the earlier start, then the name."""
    j = overlap_join(inner, outer.withColumnRenamed("name", "outer")).filter("r_start <= start AND end <= r_end")
    best = F.min(F.struct((F.col("r_end") - F.col("r_start")).alias("n"), F.col("r_start").alias("s"), F.col("outer").alias("outer")))
    return j.groupBy("id").agg(best.alias("b")).select("id", F.col("b.outer").alias("outer"))


def covers(rows: DataFrame, share: float = 0.6) -> DataFrame:
    """(by, family_id, o): pairs in which every member of `family_id` overlaps a
    member of `by`, a family before it, by `share` of its own lines or more. Before
    means more lines in all, then more value, then the smaller first place; `o` is
    the place of `by` in that order."""
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x)
    place = F.array_min(F.expr("transform(members, m -> struct(m.path AS p, m.start_line AS s, m.end_line AS e))"))
    r = rows.select("family_id", "members", F.struct((-total).alias("t"), (-F.coalesce("value", F.lit(0.0))).alias("v"), place.alias("p"), "family_id").alias("o"))
    m = r.select("family_id", "o", F.posexplode("members").alias("i", "m")).select("family_id", "o", "i", F.col("m.path").alias("file"),
        F.col("m.start_line").alias("start"), F.col("m.end_line").alias("end")).filter("file IS NOT NULL")
    outer = m.drop("i").withColumnsRenamed({"family_id": "by", "o": "by_o"}).distinct()
    j = overlap_join(m, outer).filter((F.col("by") != F.col("family_id")) & (F.col("by_o") < F.col("o")))
    j = j.filter((F.least("end", "r_end") - F.greatest("start", "r_start") + 1) >= share * (F.col("end") - F.col("start") + 1) - 1e-9)
    g = j.groupBy("by", "family_id", "by_o").agg(F.count_distinct("i").alias("covered"))
    return g.join(r.select("family_id", F.size("members").alias("n")), "family_id").filter("covered = n").select("by", "family_id", F.col("by_o").alias("o"))


def subsumed(rows: DataFrame, share: float = 0.6) -> DataFrame:
    """(family_id, by): families that one before them covers which is itself kept;
    of several the first counts. A family that only dropped ones cover is kept.

    Settled in rounds over the pairs: what no open family covers is kept, what a kept
    one covers is dropped; every round settles at least the first open family of
    every chain of covers, and chains are short."""
    pairs, state = cut_counted(covers(rows, share))
    gone = pairs.limit(0)
    while state["n"]:
        kept = pairs.select("by").distinct().join(pairs.select(F.col("family_id").alias("by")).distinct(), "by", "left_anti")
        hit = cut(pairs.join(kept, "by", "left_semi"))
        dropped = hit.select("family_id").distinct()
        gone = gone.unionByName(hit)
        left = pairs.join(dropped, "family_id", "left_anti").join(dropped.withColumnRenamed("family_id", "by"), "by", "left_anti")
        pairs, state = cut_counted(left)
    return gone.groupBy("family_id").agg(F.min(F.struct("o", "by")).alias("m")).select("family_id", F.col("m.by").alias("by"))
