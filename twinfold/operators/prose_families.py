"""Units of prose, and families of documents built from accepted pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scale import cut, prefix_sums


HEADING = rf"^#{{1,6}}{T.WS}+"


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, unit_no, kind, heading, start_line, end_line, raw): sections rooted
    at headings, the part before the first one if it is not blank, or the whole
    document where there is no heading. A line ends at a line feed, with or without
    a carriage return before it; an empty text has no unit. The lines are folded
    into sections inside each row, without a shuffle."""
    lines = F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    base = docs.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("doc_id"), lines.alias("l"))
    heads = F.filter(F.transform("l", lambda x, i: F.when(x.rlike(HEADING), i + 1)), lambda i: i.isNotNull())
    base = base.select("doc_id", "l", heads.alias("h"))
    starts = F.when(F.size("h") == 0, F.array(F.lit(1))).when(F.get("h", F.lit(0)) > 1, F.concat(F.array(F.lit(1)), "h")).otherwise(F.col("h"))
    one = base.withColumn("s", starts).select("doc_id", "l", "s", (F.size("h") > 0).alias("rooted"), F.posexplode("s").alias("unit_no", "start_line"))
    end = F.when(F.col("unit_no") + 1 < F.size("s"), F.get("s", F.col("unit_no") + 1) - 1).otherwise(F.size("l"))
    first = F.get("l", F.col("start_line") - 1)
    one = one.select("doc_id", "unit_no", "start_line", end.alias("end_line"), "rooted", first.alias("first"),
        F.array_join(F.slice("l", F.col("start_line"), end - F.col("start_line") + 1), "\n").alias("raw"))
    is_head = F.col("first").rlike(HEADING)
    heading = F.when(is_head, F.regexp_replace(F.regexp_replace("first", HEADING, ""), rf"^{T.WS}+|{T.WS}+\z", ""))
    out = one.select("doc_id", "unit_no", F.when(F.col("rooted"), "Section").otherwise("Document").alias("kind"), heading.alias("heading"),
        "start_line", "end_line", "raw", "rooted", is_head.alias("head"))
    return out.filter(~F.col("rooted") | F.col("head") | F.col("raw").rlike(rf"[^{T.WS[1:]}")).drop("rooted", "head")


def units(docs: DataFrame, key: str, text: str, least: int = 8) -> DataFrame:
    """(doc_id, unit_no, kind, heading, start_line, end_line, norm, n_words): the
    sections with at least so many words of prose."""
    u = sections(docs, key, text).withColumn("norm", T.normalize_text(F.col("raw"))).drop("raw")
    return u.withColumn("n_words", T.prose_words(F.col("norm"))).filter(F.col("n_words") >= least)


UNITS_SQL = f"""
ul AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l0 FROM documents WHERE text IS NOT NULL AND text <> ''),
um AS (SELECT doc_id, CASE WHEN l0[-1] = '' THEN l0[:-2] ELSE l0 END AS l FROM ul),
uh AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '{HEADING}')) AS h FROM um),
us AS (SELECT doc_id, l, len(h) > 0 AS rooted, CASE WHEN len(h) = 0 THEN [1] WHEN h[1] > 1 THEN list_concat([1], h) ELSE h END AS s FROM uh),
ue AS (SELECT doc_id, l, rooted, s, unnest(range(len(s))) AS unit_no FROM us),
ur AS (SELECT doc_id, unit_no::INT AS unit_no, rooted, s[unit_no + 1]::INT AS start_line, coalesce(s[unit_no + 2] - 1, len(l))::INT AS end_line,
  l[s[unit_no + 1]] AS first, array_to_string(l[s[unit_no + 1] : coalesce(s[unit_no + 2] - 1, len(l))], chr(10)) AS raw FROM ue),
units AS (SELECT doc_id, unit_no, CASE WHEN rooted THEN 'Section' ELSE 'Document' END AS kind,
  CASE WHEN regexp_matches(first, '{HEADING}') THEN regexp_replace(regexp_replace(first, '{HEADING}', ''), '^{T.WS}+|{T.WS}+\\z', '', 'g') END AS
  heading, start_line, end_line, {T.normalize_sql("raw")} AS norm
  FROM ur WHERE NOT rooted OR regexp_matches(first, '{HEADING}') OR regexp_matches(raw, '[^{T.WS[1:]}')),
uw AS (SELECT *, len(list_filter(string_split(norm, ' '), lambda x: x <> ''))::INT AS n_words FROM units)"""


def families(docs: DataFrame, cls: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(family, members, sources, score, commonness, is_exact, tier, is_template,
    removable, representative): groups of at least two documents, linked by copies
    or by strong pairs. Weak pairs inside a group count in its mean.

    tier: exact, near-high (0.9), near-med (0.7), near-low. removable: copies
    beyond the first times the whole mean of their lines."""
    member = cls.join(labels.select(F.col("v").alias("class_id"), "label"), "class_id", "left").select("id", "class_id", F.coalesce("label", "class_id").alias("family"))
    lines = docs.select(F.col("doc_id").alias("id"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("n_lines"), "source")
    m = member.join(lines, "id")
    agg = m.groupBy("family").agg(
        F.count(F.lit(1)).alias("members"), F.count_distinct("source").alias("sources"), F.count_distinct("class_id").alias("texts"),
            F.floor(F.avg("n_lines")).alias("mean_lines"), F.min("id").alias("representative")
    )
    inside = pairs.join(labels.select(F.col("v").alias("a"), F.col("label").alias("fa")),
        "a").join(labels.select(F.col("v").alias("b"), F.col("label").alias("fb")), "b").filter("fa = fb")
    mean = inside.groupBy(F.col("fa").alias("family")).agg(F.avg("score").alias("score"), F.avg("commonness").alias("commonness"))
    f = agg.filter("members >= 2").join(mean, "family", "left")
    score = F.when(F.col("texts") == 1, 1.0).otherwise(F.round(F.coalesce("score", F.lit(1.0)), 3))
    f = f.withColumn("score", score).withColumn("is_exact", F.col("texts") == 1)
    tier = F.when(F.col("is_exact"), "exact").when(F.col("score") >= 0.9, "near-high").when(F.col("score") >= 0.7, "near-med").otherwise("near-low")
    return f.select(
        "family", "members", "sources", "score", F.round("commonness", 6).alias("commonness"), "is_exact", tier.alias("tier"),
        ((F.col("members") >= 8) & (F.col("sources") >= 4) & ~F.col("is_exact")).alias("is_template"),
            ((F.col("members") - 1) * F.col("mean_lines")).alias("removable"), "representative",
    )


def ranked(fams: DataFrame) -> DataFrame:
    """All families with `rank`: templates last, then removable lines times score,
    members, representative. Ranks are running counts, so no task sees all rows."""
    order = [F.col("is_template").alias("o0"), (-F.col("removable") * F.col("score")).alias("o1"), (-F.col("members")).alias("o2"), F.col("representative").alias("o3")]
    placed = fams.select("*", *order, F.lit(1).cast("long").alias("_one"))
    return prefix_sums(placed, [], ["o0", "o1", "o2", "o3"], ["_one"]).withColumn("rank", F.col("cum__one").cast("int")).drop("o0", "o1", "o2", "o3", "_one", "cum__one")


def unit_families(members: DataFrame, sets: DataFrame, pairs: DataFrame, labels: DataFrame, lines: DataFrame, least_shared: int = 24) -> DataFrame:
    """(family, members, files, score, commonness, is_exact, tier, is_template,
    removable, representative) of units (id, class_id, doc_id, start_line, end_line),
    where classes of `sets` (class_id, size, copies, own) hold equal units and
    `pairs` (a, b, score, commonness) are the accepted pairs of classes.

    The means are over all accepted pairs of units, so a pair of classes counts once
    for each of their pairs of copies, and the copies of a class with each other, if
    they have enough grams, with score 1 and the commonness `own`. A group without an
    accepted pair is none. tier: exact; near-high (0.9), near-med (0.7); below, partial
    if the pair with the highest score has no line (`lines`) in common, else near-low."""
    lab = sets.select("class_id", "size", "copies", "own").join(labels.select(F.col("v").alias("class_id"), "label"), "class_id",
        "left").withColumn("family", F.coalesce("label", "class_id"))
    lab = cut(lab.select("class_id", "size", "copies", "own", "family"))
    side = lambda k: lab.select(F.col("class_id").alias(k), F.col("family").alias(f"f{k}"), F.col("copies").alias(f"c{k}"))
    across = pairs.join(side("a"), "a").join(side("b"), "b").filter("fa = fb").select(F.col("fa").alias("family"),
        (F.col("ca") * F.col("cb")).cast("double").alias("w"), "score", "commonness", "a", "b")
    inside = lab.filter((F.col("copies") > 1) & (F.col("size") >= least_shared)).select("family",
        (F.col("copies") * (F.col("copies") - 1) / 2).alias("w"), F.lit(1.0).alias("score"), F.col("own").alias("commonness"),
            F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    every = across.unionByName(inside)
    mean = every.groupBy("family").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("score")).alias("s"),
        F.sum(F.col("w") * F.col("commonness")).alias("c"), F.max(F.struct("score", "a", "b")).alias("best"))
    agg = members.join(lab.select("class_id", "family"), "class_id").groupBy("family").agg(
        F.count(F.lit(1)).alias("members"), F.count_distinct("doc_id").alias("files"), F.count_distinct("class_id").alias("texts"),
            F.floor(F.avg(F.col("end_line") - F.col("start_line") + 1)).cast("bigint").alias("mean_lines"), F.min("id").alias("representative")
    )
    f = cut(agg.filter("members >= 2").join(mean, "family").withColumn("score", F.col("s") / F.col("w")))
    low = f.filter("texts > 1 AND score < 0.7").select("family", F.col("best.a").alias("a"), F.col("best.b").alias("b"))
    long = lambda k: lines.select(F.col("class_id").alias(k), F.explode("lines").alias("line"))
    met = low.join(long("a"), "a").join(long("b"), ["b", "line"], "left_semi").select("family").distinct().withColumn("met", F.lit(True))
    f = f.join(met, "family", "left")
    exact = F.col("texts") == 1
    tier = F.when(exact, "exact").when(F.col("score") >= 0.9, "near-high").when(F.col("score") >= 0.7, "near-med").when(F.col("met"), "near-low").otherwise("partial")
    return f.select(
        "family", "members", "files", F.round("score", 6).alias("score"), F.round(F.col("c") / F.col("w"), 6).alias("commonness"),
            exact.alias("is_exact"), tier.alias("tier"),
        (~exact & (F.col("members") >= 8) & (F.col("files") >= 4)).alias("is_template"),
            ((F.col("members") - 1) * F.col("mean_lines")).alias("removable"), "representative",
    )


# An alignment has two equal lines or more in its best block if and only if two matches follow each other with at most one line between them on either side.
BLOCKS_SQL = """lns AS (SELECT class_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM lna),
met AS (SELECT a, b, x.i AS i, y.i AS j FROM acc JOIN lns x ON x.class_id = a JOIN lns y ON y.class_id = b AND y.line = x.line),
near2 AS (SELECT DISTINCT p.a, p.b FROM met p JOIN met q ON q.a = p.a AND q.b = p.b AND q.i - p.i BETWEEN 1 AND 2 AND q.j - p.j BETWEEN 1 AND 2)"""
FAMILIES_SQL = """
mem AS (SELECT id, class_id, coalesce(label, class_id) AS family FROM cls LEFT JOIN lab ON v = class_id),
lin AS (SELECT doc_id AS id, source, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS n_lines FROM documents),
agg AS (SELECT family, count(*) AS members, count(DISTINCT source) AS sources, count(DISTINCT class_id) AS texts, floor(avg(n_lines))::BIGINT AS
  mean_lines, min(id) AS representative
        FROM mem JOIN lin USING (id) GROUP BY family HAVING count(*) >= 2),
mean AS (SELECT p.label AS family, avg(score) AS score, avg(commonness) AS commonness FROM ok JOIN lab p ON p.v = a JOIN lab q ON q.v = b AND q.label
  = p.label GROUP BY p.label),
fam AS (SELECT a.*, CASE WHEN texts = 1 THEN 1.0 ELSE round(coalesce(m.score, 1.0), 3) END AS score, m.commonness FROM agg a LEFT JOIN mean m USING
  (family))"""
FAMILIES_SELECT = """SELECT family, members, sources, score, round(commonness, 6) AS commonness, texts = 1 AS is_exact,
       CASE WHEN texts = 1 THEN 'exact' WHEN score >= 0.9 THEN 'near-high' WHEN score >= 0.7 THEN 'near-med' ELSE 'near-low' END AS tier,
       members >= 8 AND sources >= 4 AND texts > 1 AS is_template, (members - 1) * mean_lines AS removable, representative
FROM fam"""
