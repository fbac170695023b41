"""Problem 4: how distinctive a term is per record.

Method: term frequency times smoothed logarithmic inverse document frequency,
with length normalisation. The counts of the collection are aggregated
map-side and joined back to the records' terms:

    weight = tf * (ln((1 + N) / (1 + df)) + 1)
    score  = weight / sqrt(sum of the record's squared weights)

N is the number of files of all scans and df the number of those that hold the
line; a scan's row for a line counts once however often it was delivered.

Scale: (scan, line) and (record, term) are deduplicated with map-side partial
aggregation; the join back is on the term, where a common term is hot on the
record side only and is split by `scale.lookup`.

Defined results: null lines and records without lines have no rows; a line that
no scan knows has df 0; a line that a record lists twice has tf 2 and one row;
empty tables give an empty result. Equal scores are ordered by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import lookup


def term_counts(scans: DataFrame, scan: str, term: str, df: str, size: str) -> tuple[DataFrame, DataFrame]:
    """((term, df) over all scans, one row with the collection's size n)."""
    once = scans.groupBy(scan, term).agg(F.max(df).alias("d"), F.max(size).alias("n"))
    counts = once.filter(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.sum(F.col("d").cast("long")).alias("df"))
    total = scans.groupBy(scan).agg(F.max(size).alias("n")).agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("n"))
    return counts, total


def distinctive(records: DataFrame, record: str, terms: str, counts: DataFrame, total: DataFrame) -> DataFrame:
    """(record, term, tf, df, score) for the term arrays of `records`; rows of one
    record that were delivered again count once."""
    once = records.filter(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.col(terms).alias("terms")).distinct()
    one = once.select("record", F.explode("terms").alias("term")).filter("term IS NOT NULL").groupBy("record", "term").agg(F.count(F.lit(1)).alias("tf"))
    known = lookup(one, counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    raw = known.crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * idf)  # total is one row
    norm = raw.groupBy("record").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(norm, "record").select("record", "term", "tf", "df", F.round(F.col("w") / F.col("len"), 9).alias("score"))


def _scored(spark, sf_dir: str) -> DataFrame:
    from ..tables import table

    counts, total = term_counts(table(spark, sf_dir, "line_idf"), "scan_id", "line", "df", "n_files")
    return distinctive(table(spark, sf_dir, "shared_lines"), "family_id", "rank_lines", counts, total)


def p4_scores(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(F.col("record").alias("family_id"), F.col("term").alias("line"), "tf", "df", "score")


def p4_found(spark, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).groupBy("record").agg(F.min(F.struct(-F.col("score"), F.col("df"), F.col("term"))).alias("best"))
    return s.select(F.col("record").alias("family_id"), F.col("best.term").alias("line"))


_SQL = """
WITH once AS (SELECT scan_id, line, max(df) AS d FROM line_idf GROUP BY ALL),
counts AS (SELECT line, sum(d)::BIGINT AS df FROM once WHERE line IS NOT NULL GROUP BY line),
total AS (SELECT sum(n)::BIGINT AS n FROM (SELECT max(n_files) AS n FROM line_idf GROUP BY scan_id)),
fam AS (SELECT DISTINCT family_id, rank_lines FROM shared_lines WHERE family_id IS NOT NULL),
terms AS (SELECT family_id, line, count(*) AS tf FROM (SELECT family_id, unnest(rank_lines) AS line FROM fam) WHERE line IS NOT NULL GROUP BY ALL),
raw AS (SELECT t.*, coalesce(c.df, 0) AS df, t.tf * (ln((1 + n)::DOUBLE / (1 + coalesce(c.df, 0))) + 1) AS w FROM terms t LEFT JOIN counts c USING
  (line), total),
scored AS (SELECT family_id, line, tf, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY family_id)), 9) AS score FROM raw)
"""
P4_SCORES_SQL = _SQL + "SELECT family_id, line, tf, df, score FROM scored"
P4_FOUND_SQL = _SQL + "SELECT family_id, line FROM scored QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY score DESC, df, line) = 1"
