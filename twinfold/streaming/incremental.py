"""Incremental forms: texts that arrive over time are matched against what was
seen, and events are counted in windows. Beyond the batch engine's own scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze


def first_seen(stream: DataFrame, text: str, time: str, late: str = "1 day") -> DataFrame:
    """Of equal normalised texts in a stream the first; state older than the
    watermark is dropped."""
    s = stream.withColumn("ts", F.col(time).cast("timestamp")).filter(F.col(text).isNotNull()).withColumn("key", F.md5(squeeze(F.lower(text))))
    return s.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def windowed_counts(stream: DataFrame, time: str, key: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, key, n) per tumbling or sliding window."""
    s = stream.withColumn("ts", F.col(time).cast("timestamp")).withWatermark("ts", late)
    return s.groupBy(F.window("ts", length, slide or length), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def session_counts(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = stream.withColumn("ts", F.col(time).cast("timestamp")).withWatermark("ts", late)
    return s.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def match_batches(stream: DataFrame, known: str, out: str, checkpoint: str):
    """A query that, batch by batch, writes (doc_id, first_id) of texts seen before
    to `out` and adds the new ones to the Parquet table `known`, in a folder for each
    batch. A batch that runs again reads the batches before it only and writes its
    own folders anew, so it gives the same result and leaves nothing twice."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.filter("text IS NOT NULL").select("doc_id", F.md5(squeeze(F.lower("text"))).alias("key"))
        if _exists(spark, known):
            seen = spark.read.schema("key string, first_id long, epoch long").parquet(known).filter(F.col("epoch") < epoch).drop("epoch")
        else:
            seen = spark.createDataFrame([], "key string, first_id long")
        firsts = new.groupBy("key").agg(F.min("doc_id").alias("first_id"))
        merged = firsts.join(seen.withColumnRenamed("first_id", "old"), "key", "left").select("key", F.coalesce("old", "first_id").alias("first_id"),
            F.col("old").isNull().alias("fresh"))
        new.join(merged, "key").filter("doc_id <> first_id").select("doc_id", "first_id").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        merged.filter("fresh").select("key", "first_id").write.mode("overwrite").parquet(f"{known}/epoch={epoch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
