"""Problem 1: source files that do not parse.

Method: LALR(1) tables are built from the grammars in `syntax` on the driver
(about a second, once per process) and broadcast; every file is lexed and its
whole token stream is parsed, a C file in as many readings as its conditional
groups need; the first error from which no reading goes on is reported with its
line. No tree is built and nothing is imported or run.

Scale: one narrow stage over the files, no shuffle; the tables are a constant of
some megabytes that does not grow with the data, and so is what a worker remembers
of constructions it has parsed (tables.REMEMBERED). The rates aggregate map-side.

Defined results: a null text and a path without a known extension are not checked
(`valid` null) and are not cases; an empty text is valid in every language here
but Go, whose files need a package clause; repeated rows are checked each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .syntax import languages

_SHARED: dict = {}


def _tables(spark):
    """The tables as a broadcast, one per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHARED:
        _SHARED.clear()
        _SHARED[app] = spark.sparkContext.broadcast(languages.warm())
    return _SHARED[app]


def parse_files(files: DataFrame, key: str, path: str, src: str) -> DataFrame:
    """(key, language, valid, line, what) for every row of `files`."""
    shared = _tables(files.sparkSession)
    rows = files.select(F.col(key).alias("k"), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), F.col(src).alias("src"))
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages.install(shared.value)
        for b in batches:
            lang, valid, line, what = [], [], [], []
            for ext, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                known = languages.EXTENSIONS.get(ext)
                bad = languages.check(ext, text) if known and text is not None else None
                lang.append(known)
                valid.append(None if not known or text is None else bad is None)
                line.append(bad[0] if bad else None)
                what.append(bad[1] if bad else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(valid, pa.bool_()), pa.array(line, pa.int32()), pa.array(what, pa.string())],
                    names=["k", "language", "valid", "line", "what"]
            )

    out = rows.mapInArrow(run, f"k {kind}, language string, valid boolean, line int, what string")
    return out.select(F.col("k").alias(key), "language", "valid", "line", "what")


def rates(parsed: DataFrame, repo) -> DataFrame:
    """(repo, language, n_files, n_invalid, rate) over the files that were checked."""
    g = parsed.filter("valid IS NOT NULL").groupBy(repo.alias("repo"), "language")
    g = g.agg(F.count(F.lit(1)).alias("n_files"), F.sum((~F.col("valid")).cast("long")).alias("n_invalid"))
    return g.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))


def _files(spark, sf_dir: str) -> DataFrame:
    from ..tables import table

    return table(spark, sf_dir, "source_files")


def p1_found(spark, sf_dir: str) -> DataFrame:
    return parse_files(_files(spark, sf_dir), "file_id", "path", "src").filter("NOT valid").select("file_id")


def p1_files(spark, sf_dir: str) -> DataFrame:
    return parse_files(_files(spark, sf_dir), "file_id", "path", "src")


def p1_rates(spark, sf_dir: str) -> DataFrame:
    keyed = _files(spark, sf_dir).withColumn("key", F.struct("file_id", "repo"))  # the repository travels with the key, so nothing is joined back
    return rates(parse_files(keyed, "key", "path", "src"), F.col("key.repo"))
