"""Comparison with a saved state: status against a baseline, and ignores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex


def places(families: DataFrame) -> DataFrame:
    """(family_id, place, digest): members by where they are, and by that with what
    is known of their content (kind and heading)."""
    m = families.filter("family_id IS NOT NULL").select("family_id", F.explode("members").alias("m")).filter("m.path IS NOT NULL")
    place = F.concat_ws("|", "m.path", "m.start_line", "m.end_line")
    return m.select("family_id", F.md5(place).alias("place"), F.md5(F.concat_ws("|", place, "m.kind", F.coalesce("m.heading", F.lit("")))).alias("digest")).distinct()


def snapshots(families: DataFrame, before: str) -> tuple[DataFrame, DataFrame]:
    """(baseline, current): the families reported before a day, and those from it on."""
    day = F.lit(before).cast("timestamp_ntz")
    return places(families.filter(F.col("reported_at") < day)), places(families.filter(F.col("reported_at") >= day))


def status(base: DataFrame, now: DataFrame) -> DataFrame:
    """(family_id, status) of (family_id, place, digest) tables: unchanged if every
    member's digest is in the baseline, changed if some member's digest or place is,
    new if none; resolved for baseline families of which no member is met again."""
    known = base.select("digest").distinct().withColumn("d", F.lit(True))
    spots = base.select("place").distinct().withColumn("p", F.lit(True))
    j = now.join(known, "digest", "left").join(spots, "place", "left")
    g = j.groupBy("family_id").agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("same"), F.count("p").alias("near"))
    s = g.select("family_id", F.when(F.col("same") == F.col("n"), "unchanged").when(F.col("same") + F.col("near") > 0, "changed").otherwise("new").alias("status"))
    met = base.join(now.select("place").distinct(), "place", "left_semi").select("family_id").distinct()
    gone = base.select("family_id").distinct().join(met, "family_id", "left_anti").join(now.select("family_id").distinct(), "family_id", "left_anti")
    return s.unionByName(gone.withColumn("status", F.lit("resolved")))


def check_ignores(entries: list[dict]) -> None:
    """Each entry needs a reason and at least one selector; other fields are errors."""
    for e in entries:
        unknown = set(e) - {"family_id", "paths", "languages", "reason", "note", "owner", "expires_at"}
        if unknown:
            raise ValueError(f"unknown field {sorted(unknown)[0]}")
        if not (e.get("reason") or "").strip():
            raise ValueError("an ignore needs a reason")
        if not any(e.get(k) for k in ("family_id", "paths", "languages")):
            raise ValueError("an ignore needs a selector")


def without_ignored(rows: DataFrame, entries: list[dict], today: str) -> DataFrame:
    """`rows` without the families an entry matches. Every selector that is set must
    hold: the id, all members under one of the paths, all languages in the set. An
    entry is over when its day lies before `today`."""
    check_ignores(entries)
    tests = []
    for e in entries:
        if e.get("expires_at") and e["expires_at"] < today:
            continue
        t = F.lit(True)
        if e.get("family_id"):
            t &= F.col("family_id") == e["family_id"]
        if e.get("paths"):
            pats = [glob_regex(g) for g in e["paths"]]
            t &= (F.size("members") > 0) & F.forall("members", lambda m: F.coalesce(reduce(lambda a, b: a | b, [m["path"].rlike(p) for p in pats]), F.lit(False)))
        if e.get("languages"):
            t &= (F.size("langs") > 0) & F.forall("langs", lambda x: x.isin(*e["languages"]))
        tests.append(F.coalesce(t, F.lit(False)))
    return rows.filter(~reduce(lambda a, b: a | b, tests)) if tests else rows


_PLACES_SQL = """SELECT DISTINCT family_id, md5(concat_ws('|', m.path, m.start_line, m.end_line)) AS place, md5(concat_ws('|', m.path, m.start_line,
  m.end_line, m.kind, coalesce(m.heading, ''))) AS digest
  FROM (SELECT family_id, unnest(members) AS m FROM families WHERE family_id IS NOT NULL AND {}) WHERE m.path IS NOT NULL"""
STATUS_SQL = f"""
WITH base AS ({_PLACES_SQL.format("reported_at < TIMESTAMP '2024-07-01'")}), now_ AS ({_PLACES_SQL.format("reported_at >= TIMESTAMP '2024-07-01'")}),
g AS (SELECT n.family_id, count(*) AS n, count(*) FILTER (digest IN (SELECT digest FROM base)) AS same, count(*) FILTER (place IN (SELECT place FROM
  base)) AS near FROM now_ n GROUP BY n.family_id),
met AS (SELECT DISTINCT family_id FROM base WHERE place IN (SELECT place FROM now_))
SELECT family_id, CASE WHEN same = n THEN 'unchanged' WHEN same + near > 0 THEN 'changed' ELSE 'new' END AS status FROM g
UNION ALL SELECT DISTINCT family_id, 'resolved' FROM base WHERE family_id NOT IN (SELECT family_id FROM met) AND family_id NOT IN (SELECT family_id
  FROM now_)"""
