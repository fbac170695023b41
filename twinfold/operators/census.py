"""Counts over what was found and what was left out: mined literals, gap impact,
exclusions, reachability of labelled pairs, calibration, and gates on the counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scale import prefix_sums
from .similarity import shingles_of

#: Values that units are run on (fixed values): lists and numbers that tell orders, signs and folds apart.
POOL = ([1, 2, 3, 4], 3, 0, -1, [5, 1, 4, 2, 8], 7, [], 2)
WIDE_POOL = (*POOL, -7, 100, 1, [2, 2, 2], [0], [-3, -1, -2], [4, 3, 2, 1], [10, -10, 5, -5])
#: Bounds of the bins of a calibration.
BINS = (0.5, 0.7, 0.8, 0.9, 1.0)


def battery(spark: SparkSession, wide: bool = False) -> DataFrame:
    """(row, slot, number, list): the fixed inputs, one row per value. Row e takes in
    slot j the pool's value at the j-th digit of e."""
    pool, width, count = (WIDE_POOL, 5, 243) if wide else (POOL, 4, 64)
    n = len(pool)
    values = spark.createDataFrame([(i, None if isinstance(v, list) else v, v if isinstance(v, list) else None) for i, v in enumerate(pool)],
        "i int, number bigint, list array<bigint>")
    cells = spark.range(count).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("slot"))
    at = (F.floor(F.col("row") / F.pow(F.lit(n), F.col("slot"))) % n).cast("int")
    return cells.withColumn("i", at).join(F.broadcast(values), "i").select("row", "slot", "number", "list")  # a pool of at most 16 values


def probes(spark: SparkSession, literals: DataFrame, width: int = 4) -> DataFrame:
    """(kind, literal, slot): every mined literal once in every slot."""
    return literals.select("kind", "literal", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("slot"))


def trivial_behaviour(results: Column) -> Column:
    """Fewer than two different results, or nothing but null."""
    return (F.size(F.array_distinct(results)) < 2) | ~F.exists(results, lambda x: x.isNotNull())


def behaviour_hash(results: Column) -> Column:
    """Equal for equal results in the same order."""
    return F.md5(F.to_json(F.struct(results.alias("r")), {"ignoreNullFields": "false"}))


def mined_literals(files: DataFrame, src: str, k: int = 16) -> DataFrame:
    """(kind, literal, n): the k most frequent string and the k most frequent whole
    number literals; of equally frequent ones the smaller first."""
    both = files.select(F.explode(F.array(
        F.struct(F.lit("string").alias("kind"), F.regexp_extract_all(src, F.lit(r'"([^"\\\n]*)"'), F.lit(1)).alias("x")),
        F.struct(F.lit("int").alias("kind"), F.regexp_extract_all(src, F.lit(r"\b([0-9]{1,9})\b"), F.lit(1)).alias("x")),
    )).alias("s")).select("s.kind", F.explode("s.x").alias("literal"))
    n = both.groupBy("kind", "literal").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.when(F.col("kind") == "int", F.col("literal").cast("bigint")), F.col("literal")]
    top = [n.filter(F.col("kind") == x).orderBy(*order).limit(k) for x in ("string", "int")]  # a top-k report
    return top[0].unionByName(top[1])


def gap_impact(nodes: DataFrame) -> DataFrame:
    """(lang, kind, files, units, lines, raw, impact) of (lang, kind, file, lines, raw
    BOOLEAN): what it would bring to handle a kind of construct."""
    g = nodes.groupBy("lang", "kind").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("units"), F.sum("lines").alias("lines"),
        F.sum(F.col("raw").cast("long")).alias("raw"))
    impact = 10 * (F.col("units") * F.log1p("files") + F.log1p("lines") + F.log1p("raw"))
    return g.withColumn("impact", F.round(impact, 4))


def rollups(rows: DataFrame, reason: Column, tag: Column) -> DataFrame:
    """(reason, tag, n): why rows were left out, by construct."""
    return rows.groupBy(reason.alias("reason"), tag.alias("tag")).agg(F.count(F.lit(1)).alias("n")).filter("reason IS NOT NULL")


def reachable(gold: DataFrame, units: DataFrame, candidates: DataFrame) -> DataFrame:
    """(gold, unit_reachable, candidate_reachable): of labelled pairs (id, l_file,
    l_start, l_end, r_file, r_start, r_end) those of which each side is covered by
    half or more by a unit (unit, file, start, end), two different ones, and those
    whose units are a candidate pair (a, b). Of several units the one that covers
    most counts, then the smaller one."""
    from .spans import overlap_join

    ends = gold.select("id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_file").alias("file"),
        F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end")) for s in "lr"))).alias("x")).select("id", "x.*")
    j = overlap_join(ends, units)
    share = (F.least("end", "r_end") - F.greatest("start", "r_start") + 1) / (F.col("end") - F.col("start") + 1)
    best = j.withColumn("share", share).filter("share >= 0.5").groupBy("id",
        "side").agg(F.min(F.struct((-F.col("share")).alias("s"), "unit")).alias("m")).select("id", "side", F.col("m.unit").alias("unit"))
    two = best.groupBy("id").agg(F.min("unit").alias("a"), F.max("unit").alias("b"), F.count(F.lit(1)).alias("n")).filter("n = 2 AND a <> b")
    known = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("c", F.lit(1))
    met = two.join(known, ["a", "b"], "left").agg(F.count(F.lit(1)).alias("unit_reachable"), F.count("c").alias("candidate_reachable"))
    return gold.agg(F.count(F.lit(1)).alias("gold")).crossJoin(met)  # one row each


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(k, i): the rows numbered from 0 in the order of (order, key), by running counts."""
    return prefix_sums(rows.select(F.col(order).alias("o"), F.col(key).alias("k"), F.lit(1).cast("bigint").alias("_one")), [], ["o", "k"],
        ["_one"]).select("k", (F.col("cum__one") - 1).alias("i"))


def neighbours(rows: DataFrame, key: str, order: str, near: int = 32) -> DataFrame:
    """(a, b): every row with the `near` ones behind it in the order of (order, key).
    A row meets its block and the next one."""
    placed = numbered(rows, key, order)
    block = F.floor(F.col("i") / near)
    left = placed.select(F.col("k").alias("a"), F.col("i").alias("x"), F.explode(F.array(block, block + 1)).alias("b0"))
    right = placed.select(F.col("k").alias("b"), F.col("i").alias("y"), block.alias("b0"))
    return left.join(right, "b0").filter((F.col("y") > F.col("x")) & (F.col("y") - F.col("x") <= near)).select("a", "b")


def blocks(placed: DataFrame, near: int = 32, rows: int = 1024) -> DataFrame:
    """`placed` with `block`: runs of `rows` numbers `i`, each with the `near` ones
    behind it, which come twice."""
    own = F.floor(F.col("i") / rows)
    return placed.withColumn("block", F.explode(F.when((F.col("i") % rows < near) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))))


def block_likeness(sets: DataFrame, least: float = 0.5, near: int = 32, rows: int = 1024) -> DataFrame:
    """(jaccard, same) of each text of `blocks` (block, i, words w, source) and the `near`
    ones behind it, where the Jaccard of their 5-word shingles is `least` or more. A
    shingle that stands in one text of a block costs nothing more; a text is in one or
    two tasks, however many pairs it makes."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at = t.column("i").to_numpy()
        number: dict[bytes, int] = {}  # shingles by number, in this block only
        grams = [[number.setdefault(s, len(number)) for s in shingles_of(w.as_py())] for w in t.column("w")]
        size = np.array([len(g) for g in grams])
        first = at.min()
        rank = np.repeat(at - first, size)
        flat = np.fromiter((x for g in grams for x in g), np.int64, int(size.sum()))
        order = np.lexsort((rank, flat))
        flat, rank = flat[order], rank[order]
        shared = np.zeros((int(at.max() - first) + 1) * (near + 1), np.int64)
        left = np.arange(len(flat))
        for s in range(1, near + 1):
            left = left[left + s < len(flat)]
            left = left[(flat[left] == flat[left + s]) & (rank[left + s] - rank[left] <= near)]
            if not len(left):
                break
            np.add.at(shared, rank[left] * (near + 1) + rank[left + s] - rank[left], 1)
        pairs = np.flatnonzero(shared)
        row = np.full(int(at.max() - first) + 1, -1)
        row[at - first] = np.arange(len(at))
        x, y = row[pairs // (near + 1)], row[pairs // (near + 1) + pairs % (near + 1)]
        k = shared[pairs]
        j = k / (size[x] + size[y] - k)
        ok = (j >= least) & (at[x] // rows == t.column("block")[0].as_py())
        source = t.column("source").to_pylist()
        same = [source[a] == source[b] for a, b in zip(x[ok], y[ok])]
        return pa.table({"jaccard": pa.array(j[ok], pa.float64()), "same": pa.array(same, pa.bool_())})

    return sets.select("block", "i", "w", "source").groupBy("block").applyInArrow(run, "jaccard double, same boolean")


def calibration(pairs: DataFrame) -> DataFrame:
    """(bin, pairs, equal) of (jaccard, same BOOLEAN): how often pairs of a likeness
    behave alike; pairs below the lowest bin do not count."""
    low = F.when(F.col("jaccard") >= 1.0, 1.0)
    for b in BINS[-2::-1]:
        low = low.when(F.col("jaccard") >= b, b)
    return pairs.withColumn("bin", low).filter("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("same").cast("long")).alias("equal"))


def over_budget(counts: DataFrame, budget: DataFrame) -> DataFrame:
    """(key, n, budget, over): counts (key, n) against a stored budget (key, budget);
    a key without one has none."""
    j = counts.join(budget, "key", "full").select("key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.coalesce("budget", F.lit(0)).cast("bigint").alias("budget"))
    return j.withColumn("over", F.greatest(F.col("n") - F.col("budget"), F.lit(0)))


def macro_f1(slices: DataFrame) -> DataFrame:
    """(slices, macro_f1): the mean of the F1 of slices; one without hits counts 0."""
    return slices.agg(F.count(F.lit(1)).alias("slices"), F.round(F.avg(F.coalesce("f1", F.lit(0.0))), 6).alias("macro_f1"))


def precision_by_group(scored: DataFrame, group: str, k: int = 10) -> DataFrame:
    """(group, n, precision): the share of good ones among the first k by score."""
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col("id"))
    first = scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return first.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("good").cast("double")), 6).alias("precision"))


