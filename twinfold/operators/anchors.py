"""Pairs and findings from parts that units share: rare sub-trees, whole value
multisets, helpers written out again inside larger units, and single literals
that vary. Tables follow the unit schema: unit_id, path, start_line, end_line and
arrays of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import lookup

#: A rare anchor weighs at least WEIGHT and is held by 2 to MOST units.
WEIGHT, MOST = 20, 6


def rare_anchor_pairs(units: DataFrame) -> DataFrame:
    """(a, b, weight) of units (unit_id, anchors ARRAY<STRUCT<hash, weight>>) that
    share a rare heavy anchor; weight is the largest of the smaller ones. At most
    15 pairs come from an anchor, since at most MOST units hold it."""
    long = units.select("unit_id", F.explode("anchors").alias("x")).select("unit_id", F.col("x.hash").alias("h"),
        F.col("x.weight").alias("w")).filter(F.col("w") >= WEIGHT)
    long = long.groupBy("unit_id", "h").agg(F.max("w").alias("w"))
    rare = long.join(long.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, MOST)), "h")
    l, r = rare.alias("l"), rare.alias("r")
    p = l.join(r, (F.col("l.h") == F.col("r.h")) & (F.col("l.unit_id") < F.col("r.unit_id")))
    return p.groupBy(F.col("l.unit_id").alias("a"), F.col("r.unit_id").alias("b")).agg(F.max(F.least("l.w", "r.w")).alias("weight"))


def anchor_score(weight: Column) -> Column:
    """0.72 for the lightest anchor, towards 0.90 for heavy ones."""
    extra = F.greatest(weight - WEIGHT, F.lit(0))
    return 0.72 + (0.90 - 0.72) * extra / (extra + 60)


def value_classes(units: DataFrame, least: int = 4) -> DataFrame:
    """(unit_id, class_id, n): units with the same value multiset of at least
    `least` elements, exact_safe ones only; classes of one are left out."""
    v = units.filter(F.col("exact_safe") & (F.size("value") >= least)).select("unit_id", F.array_sort("value").alias("v"))
    g = v.groupBy("v").agg(F.min("unit_id").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return v.join(g, "v").select("unit_id", "class_id", "n")


def nested(a_path: Column, a_start: Column, a_end: Column, b_path: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two spans of one file lie inside each other."""
    return (a_path == b_path) & (((a_start <= b_start) & (b_end <= a_end)) | ((b_start <= a_start) & (a_end <= b_end)))


def structural_score(value_j: Column, shape_j: Column, offset: Column, smaller: Column) -> Column:
    """The fuzzy score of a pair; equal behaviour of some size settles it alone."""
    return F.when((value_j >= 0.9) & (smaller >= 4), value_j).otherwise(0.3 * value_j + 0.5 * shape_j + 0.2 * offset)


def reinvented(units: DataFrame) -> DataFrame:
    """(container, helper, hash): units that write out what a pure helper already
    returns. The helper has one return and at least 8 values and 20 tokens, the
    container is larger, holds the return as an anchor inside its own span, meets
    every guard of the helper and does not call it already. Of several helpers of
    an anchor the first by path and line counts."""
    h = helpers(units)
    c = units.select(F.col("unit_id").alias("container"), "start_line", "end_line", "token_count", F.explode("anchors").alias("x"))
    c = c.filter("x.line_start >= start_line AND x.line_end <= end_line").select("container", "token_count", F.col("x.hash").alias("hash")).distinct()
    j = lookup(c, h, "hash").withColumn("h", F.filter("h", lambda x: F.col("token_count") > x["h_tokens"])).filter("size(h) > 0").drop("token_count")
    j = j.join(units.select(F.col("unit_id").alias("container"), "value", "called_helper_returns"), "container")
    j = j.filter(~F.coalesce(F.array_contains("called_helper_returns", F.col("hash")), F.lit(False)))
    met = F.filter("h", lambda x: F.size(F.array_except(x["sinks"], F.col("value"))) == 0)
    j = j.select("container", "hash", F.array_min(F.transform(met, lambda x: x["m"])).alias("m")).filter("m IS NOT NULL")
    return j.select("container", F.col("m.helper").alias("helper"), "hash")


def helpers(units: DataFrame) -> DataFrame:
    """(hash, h ARRAY<STRUCT<sinks, h_tokens, m STRUCT<o, helper>>>): of the helpers
    that return a value the first of each size and each set of guards. The others can
    be no container's first, so equal helpers never multiply with the containers; a
    container is larger than its helper and so is never its own."""
    h = units.filter("pure_single_return AND exact_safe AND NOT used_length_contract AND size(returns) = 1 AND size(value) >= 8 AND token_count >= 20")
    h = h.select(F.get("returns", F.lit(0)).alias("hash"), F.array_sort(F.array_distinct("cond_sinks")).alias("sinks"), F.col("token_count").alias("h_tokens"),
        F.struct(F.struct("path", "start_line", "unit_id").alias("o"), F.col("unit_id").alias("helper")).alias("m"))
    h = h.groupBy("hash", "sinks", "h_tokens").agg(F.min("m").alias("m"))
    return h.groupBy("hash").agg(F.collect_list(F.struct("sinks", "h_tokens", "m")).alias("h"))


def abstraction(members: DataFrame) -> DataFrame:
    """(family_id, pos, kinds, parametric) of families whose members differ in the
    literal at exactly one position. members: (family_id, lang, kind, literals
    ARRAY<STRUCT<kind, value>>); languages, kinds and lengths must be the same."""
    same = members.groupBy("family_id").agg(F.count_distinct("lang", "kind", F.size("literals")).alias("n"),
        F.count(F.lit(1)).alias("m")).filter("n = 1 AND m > 1").select("family_id")
    pos = members.join(same, "family_id").select("family_id", F.posexplode("literals").alias("pos", "x"))
    varies = pos.groupBy("family_id", "pos").agg(F.count_distinct("x.kind", "x.value").alias("n"), F.array_sort(F.collect_set("x.kind")).alias("kinds")).filter("n > 1")
    one = varies.groupBy("family_id").agg(F.count(F.lit(1)).alias("k"), F.first("pos").alias("pos"), F.first("kinds").alias("kinds")).filter("k = 1")
    return one.select("family_id", "pos", "kinds", (F.size("kinds") > 1).alias("parametric"))
