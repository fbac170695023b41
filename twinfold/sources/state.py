"""Files that steer a run: settings, ignores, baselines, diffs; and the reports."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES, PROSE_EXCLUDED, extension, glob_regex, language_of, skip_reason
from ..operators.scale import dense_ids
from ..operators.temporal import check_ignores

_SETTINGS = {"mode", "exclude", "sort", "top", "min_lines", "min_tokens", "threshold", "baseline", "ignores"}


def ignore_rules(root: str) -> list[tuple[str, bool]]:
    """(pattern of whole paths, whether it takes back) from the .gitignore files of a
    local folder, outer files first; the last pattern that matches a path decides."""
    out = []
    base = Path(root)
    for f in sorted(base.rglob(".gitignore"), key=lambda p: (len(p.parts), str(p))):
        folder = re.escape(f.parent.as_posix().rstrip("/"))
        for line in f.read_text(errors="replace").splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            back, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
            rooted, only_folder = "/" in line.rstrip("/"), line.endswith("/")
            body = glob_regex(line.strip("/")).removeprefix("^").removesuffix("$")
            out.append((f"{folder}/{'' if rooted else '(?:.*/)?'}{body}{'/.*' if only_folder else '(?:/.*)?'}$", back))
    return out


def not_ignored(files: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    if not rules:
        return files
    gone = F.lit(False)
    for pattern, back in rules:
        gone = F.when(F.col("path").rlike(pattern), not back).otherwise(gone)
    return files.filter(~gone)


def _read(spark: SparkSession, roots: list[str], extensions: list[str], exclude: list[str]) -> DataFrame:
    """(path, src) of the files with these extensions that no rule leaves out; bad bytes replaced."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(sorted(extensions)) + "}").option("recursiveFileLookup", "true").load(roots)
    f = read.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("src"))
    for g in exclude:
        f = f.filter(~F.col("path").rlike(glob_regex("**/" + g)))
    return not_ignored(f, [r for root in roots if Path(root).is_dir() for r in ignore_rules(root)])


def discover(spark: SparkSession, roots: list[str], exclude: list[str] = ()) -> DataFrame:
    """(file_id, path, lang, src) of the source files below `roots`; ids follow the
    order of the paths. Left out are what .gitignore files name, binary content, the
    output of highlighters and C++ headers under a C name."""
    f = _read(spark, roots, list(LANGUAGES), list(exclude)).filter(extension(F.col("path")).isin(*LANGUAGES))
    f = f.filter(skip_reason(F.col("path"), F.col("src")).isNull()).withColumn("lang", language_of(F.col("path")))
    return f.join(dense_ids(f, ["path"], "file_id"), "path").select("file_id", "path", "lang", "src")


def discover_prose(spark: SparkSession, roots: list[str], exclude: list[str] = ()) -> DataFrame:
    """(file_id, path, src) of the Markdown files below `roots`, without the folders
    of PROSE_EXCLUDED and what .gitignore files name."""
    f = _read(spark, roots, ["md", "markdown"], list(exclude)).filter(~F.col("path").rlike("/(?:" + "|".join(map(re.escape, PROSE_EXCLUDED)) + ")/"))
    return f.join(dense_ids(f, ["path"], "file_id"), "path").select("file_id", "path", "src")


def settings(path: str) -> dict:
    """The [query] table of a TOML file; unknown keys are errors."""
    with open(path, "rb") as f:
        q = tomllib.load(f).get("query", {})
    if unknown := set(q) - _SETTINGS:
        raise ValueError(f"unknown setting {sorted(unknown)[0]}")
    return q


def ignores(path: str) -> list[dict]:
    """A JSON list of ignores, or an object with one under `ignores`."""
    data = json.loads(Path(path).read_text())
    entries = data["ignores"] if isinstance(data, dict) else data
    check_ignores(entries)
    return entries


_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@")


def changed_ranges(diff: str) -> list[tuple[str, int, int]]:
    """(file, start, end) on the old side of a unified diff without context. A pure
    insertion after line a is the empty range (a + 1, a)."""
    out, name, left = [], None, [0, 0]
    for line in diff.splitlines():
        if left[0] > 0 and line.startswith("-"):
            left[0] -= 1
        elif left[1] > 0 and line.startswith("+"):
            left[1] -= 1
        elif line.startswith("--- "):
            name = None if line[4:].strip() == "/dev/null" else re.sub(r"^[ab]/", "", line[4:].split("\t")[0].strip())
        elif m := _HUNK.match(line):
            n = int(m[2]) if m[2] is not None else 1
            new = re.search(r"\+\d+(?:,(\d+))?", line)
            left = [n, int(new[1]) if new[1] is not None else 1]
            if name:
                a = int(m[1])
                out.append((name, a, a + n - 1) if n else (name, a + 1, a))
    return out


def changed_table(spark: SparkSession, diff: str) -> DataFrame:
    return spark.createDataFrame(changed_ranges(diff), "file string, start int, end int")


def write_baseline(members: DataFrame, path: str) -> None:
    """(family_id, path, digest) as JSON lines, one family per line."""
    g = members.groupBy("family_id").agg(F.array_sort(F.collect_set(F.struct("path", "digest"))).alias("members"))
    g.withColumn("schema_version", F.lit(2)).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.schema("schema_version int, family_id string, members array<struct<path:string,digest:string>>").json(path)
    return f.select("family_id", F.explode("members").alias("m")).select("family_id", "m.path", "m.digest")


def missing_from_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content (and language) has no row in the feature cache yet."""
    keyed = files.withColumn("key", F.sha2(F.concat_ws("\0", "lang", "src"), 256))
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")


def add_to_cache(features: DataFrame, cache: str, options: str) -> None:
    """Append features (key, ...) to the cache, in a folder of their own for each
    digest of the options, so that other options never meet them."""
    features.withColumn("options", F.lit(options)).write.mode("append").partitionBy("options").parquet(cache)


def read_cache(spark: SparkSession, cache: str, options: str) -> DataFrame:
    return spark.read.parquet(cache).filter(F.col("options") == options).drop("options")


def write_predictions(pairs: DataFrame, path: str, tool: str = "twinfold") -> None:
    """Pairs with a column `json` as JSON lines in the form that evaluations read."""
    pairs.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(tool).alias("tool"),
        F.col("json").alias("duplicate"))).alias("value")).write.mode("overwrite").text(path)


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF result object per (family_id, tier, file, start, end), as JSON text."""
    region = F.struct(F.col("start").alias("startLine"), F.col("end").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    g = findings.groupBy("family_id", "tier").agg(F.array_sort(F.collect_set(place)).alias("locations"))
    msg = F.struct(F.concat(F.lit("duplicated in "), F.size("locations"), F.lit(" places")).alias("text"))
    return g.select(F.to_json(F.struct(F.lit("duplicate").alias("ruleId"), msg.alias("message"), "locations",
        F.struct(F.col("family_id").alias("family")).alias("partialFingerprints"))).alias("result"))


def sarif_document(results: list[str]) -> str:
    """The envelope around the result objects of a (bounded) report."""
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "twinfold", "rules": [{"id": "duplicate"}]}},
        "results": [json.loads(r) for r in results]}]})


def markdown_report(rows: list, columns: list[str]) -> str:
    """A table of a (bounded) report."""
    cell = lambda v: str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)])
