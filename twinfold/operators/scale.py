"""Building blocks that keep a plan distributed: lineage cuts, global ids and
prefix sums without a single-task window, and joins that survive hot keys.

None of them moves an unbounded set to the driver. What is broadcast is bounded
by the number of partitions (`prefix_sums`, `dense_ids`) or by MAX_HOT rows
(`lookup`).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key is hot if it holds more than max(HOT_ROWS, rows / MAX_HOT) rows, so there are at most MAX_HOT hot keys.
HOT_ROWS, MAX_HOT = 200_000, 10_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: `spark.checkpoint.dir` of the session; a
    temporary one, removed at the end, only where that is unset and the session is
    local."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="twinfold-checkpoint-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
    sc.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and drop its lineage.

    A checkpointed DataFrame keeps the constraints and statistics of the plan it
    came from; over the rounds of an iterative operator they multiply until
    planning takes longer than running. So the rows are wrapped afresh, and
    adaptive execution sizes the joins that follow. The files go when the rows are
    not referred to any more, if `spark.cleaner.referenceTracking.cleanCheckpoints`
    is set, or at once by `release`."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    done = df.checkpoint(eager=True)._jdf
    rdd = done.queryExecution().toRdd()
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(rdd, done.schema(), False), spark)
    out._cut_rdd = done.queryExecution().logical().rdd()
    return out


def cut_counted(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """`cut` with figures over the rows (`n`, their number, and any others), taken
    while they are written. A task that runs again may count twice, so the figures
    steer how to go on, never what comes out."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *(F.coalesce(c, F.lit(0)).alias(k) for k, c in figures.items())))
    return out, seen.get


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames of `cut` that nothing reads any more."""
    for df in frames:
        rdd = getattr(df, "_cut_rdd", None)
        file = rdd.getCheckpointFile() if rdd is not None else None
        if file is not None and file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as there are cores, for a stage that
    computes much on few bytes. Data that already has that many is left alone, so
    only inputs of a few file splits are ever moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(2 * cores)


def _offsets(parts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Exclusive running totals over partitions. `parts` has one row per
    (keys, partition), so the window is over as many rows as there are partitions."""
    w = Window.partitionBy(*keys, F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "_pid", *(F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_off_{s}") for s in sums))


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], sums: list[str], partitions: int | None = None) -> DataFrame:
    """`df` with `cum_<s>` for each of `sums`: the inclusive running total of `s`
    within `keys` in the order of `order`. (keys, order) must be unique; the
    number of distinct `keys` must be small (a handful of criteria, say).

    Rows are range-partitioned on (keys, order), summed inside each partition and
    shifted by the totals of the partitions before, so no task sees all rows.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "_pid").agg(*(F.sum(s).alias(s) for s in sums))
    off = F.broadcast(_offsets(totals, keys, sums))
    w = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.select("*", *(F.sum(s).over(w).alias(f"_in_{s}") for s in sums))
    if keys:
        cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l._pid") == F.col("r._pid")]
        joined = out.alias("l").join(off.alias("r"), cond)
    else:
        joined = out.alias("l").join(off.alias("r"), [F.col("l._pid") == F.col("r._pid")])
    return joined.select(
        *(F.col(f"l.{c}") for c in df.columns),
        *((F.col(f"l._in_{s}") + F.col(f"r._off_{s}")).alias(f"cum_{s}") for s in sums),
    )


def dense_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Distinct rows of `df` numbered 0.. in the order of `order`; ids keep that
    order, so the smallest id stands for the smallest row."""
    one = df.select(*order).distinct().withColumn("_one", F.lit(1).cast("long"))
    return prefix_sums(one, [], order, ["_one"]).select(*order, (F.col("cum__one") - 1).alias(name))


def hot_keys(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """(key, _split): the keys above the hot threshold and how many pieces each
    is cut into. At most MAX_HOT rows."""
    n = df.count() if rows is None else rows
    most = max(HOT_ROWS, n // MAX_HOT)
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    return per.select(F.col(key), (F.ceil(F.col("_n") / F.lit(most)) + 1).cast("int").alias("_split"))


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """`big` joined with `small` on `key`, unique in `small`. A hot key of `big`
    is spread over several tasks and its row of `small` repeated for each. The
    salt is a hash of the row, so a task that runs again after a lost executor
    sends every row to the same place."""
    n = big.count() if rows is None else rows
    if n <= HOT_ROWS:  # no key can be hot
        return big.join(small, key, how)
    hot = hot_keys(big, key, n)
    salted = (
        big.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.when(F.col("_split").isNull(), 0).otherwise(F.pmod(F.xxhash64(*big.columns), F.col("_split")).cast("int")))
        .drop("_split")
    )
    spread = (
        small.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_split").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_split") - 1))))
        .drop("_split")
    )
    return salted.join(spread, [key, "_salt"], how).drop("_salt")
