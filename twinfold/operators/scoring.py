"""Scores of the code channels and what caps them, and the witness of a group, as
Column expressions over feature arrays of two units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import anchor_score
from .similarity import multiset_jaccard

#: A unit is a data table from this share of literals among its values, or this many.
DATA_SHARE, DATA_LITERALS = 0.20, 25
#: What is left of a score where no returned value agrees.
RETURN_BASE = 0.80
#: Values an exact match must have.
EXACT_VALUES = 4


def exact(value_a: Column, value_b: Column, safe_a: Column, safe_b: Column) -> Column:
    """1 for equal value multisets of units that are safe to compare so, else null."""
    return F.when(safe_a & safe_b & (F.size(value_a) >= EXACT_VALUES) & (F.array_sort(value_a) == F.array_sort(value_b)), 1.0)


def is_data(value: Column, literals: Column) -> Column:
    return (F.size(value) > 0) & ((F.size(literals) / F.size(value) >= DATA_SHARE) | (F.size(literals) >= DATA_LITERALS))


def data_gate(score: Column, value_a: Column, literals_a: Column, value_b: Column, literals_b: Column) -> Column:
    """Two data tables are alike only as far as their literals are."""
    both = is_data(value_a, literals_a) & is_data(value_b, literals_b)
    return F.when(both, F.least(score, multiset_jaccard(literals_a, literals_b))).otherwise(score)


def return_gate(score: Column, returns_a: Column, returns_b: Column) -> Column:
    """Units that return different values are no behavioural copies."""
    cap = RETURN_BASE + (1 - RETURN_BASE) * multiset_jaccard(returns_a, returns_b)
    return F.when((F.size(returns_a) > 0) & (F.size(returns_b) > 0), F.least(score, cap)).otherwise(score)


def strict(value_j: Column, shape_j: Column, offset: Column, gated) -> Column:
    """The behavioural channel: 0.3 value, 0.2 shape, 0.5 alignment, unless value and
    shape alone rule the pair out; `gated` applies the gates."""
    low = 0.6 * value_j + 0.4 * shape_j
    return F.when(low < 0.15, low).otherwise(gated(0.3 * value_j + 0.2 * shape_j + 0.5 * offset))


def near(value_j: Column, shape_j: Column, offset: Column, values: Column, anchor: Column) -> Column:
    """The structural channel: 0.3 value, 0.5 shape, 0.2 alignment; a nearly equal
    value multiset settles it, and a rare shared part of weight `anchor` lifts it."""
    blend = F.when(0.6 * value_j + 0.4 * shape_j < 0.15, 0.6 * value_j + 0.4 * shape_j).otherwise(0.3 * value_j + 0.5 * shape_j + 0.2 * offset)
    partial = F.greatest(0.3 * value_j + 0.5 * shape_j, anchor_score(anchor))
    return F.when((values >= EXACT_VALUES) & (value_j >= 0.9), value_j).when(F.coalesce(anchor, F.lit(0)) > 0, partial).otherwise(blend)


def channel_max(*scores: Column) -> Column:
    """The best of the channels that gave a score."""
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def group_witness(members: DataFrame) -> DataFrame:
    """(group_id, kind, value_nodes, mean_value, mean_shape) of (group_id, unit_id,
    value, shapes, anchors ARRAY<BIGINT>, safe): exact if all values are equal and
    safe, a shared part if one anchor is in all of them, else the mean likeness with
    the first unit."""
    one = members.select("group_id", "unit_id", F.array_sort("value").alias("value"), "shapes", F.array_distinct("anchors").alias("anchors"), "safe")
    first = one.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("value", "unit_id").alias("v0"), F.min_by("shapes", "unit_id").alias("s0"),
            F.min("unit_id").alias("u0"), F.count_distinct("value").alias("values"), F.min("safe").alias("safe")
    )
    shared = one.select("group_id", F.explode("anchors").alias("h")).groupBy("group_id",
        "h").agg(F.count(F.lit(1)).alias("k")).groupBy("group_id").agg(F.max("k").alias("most"))
    others = one.join(first.select("group_id", "u0", "v0", "s0"), "group_id").filter("unit_id <> u0")
    mean = others.groupBy("group_id").agg(F.round(F.avg(multiset_jaccard(F.col("v0"), F.col("value"))), 3).alias("mv"),
        F.round(F.avg(multiset_jaccard(F.col("s0"), F.col("shapes"))), 3).alias("ms"))
    j = first.join(shared, "group_id", "left").join(mean, "group_id", "left")
    kind = F.when((F.col("values") == 1) & F.col("safe") & (F.size("v0") >= EXACT_VALUES),
        "exact").when((F.col("n") >= 2) & (F.col("most") == F.col("n")), "subdag").otherwise("similar")
    similar = kind == "similar"
    return j.select("group_id", kind.alias("kind"), F.when(kind == "exact", F.size("v0")).alias("value_nodes"),
        F.when(similar, F.coalesce("mv", F.lit(0.0))).alias("mean_value"), F.when(similar, F.coalesce("ms", F.lit(0.0))).alias("mean_shape"))
