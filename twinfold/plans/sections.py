"""Registered queries over the sections of `documents`: near copies by the grams of
3 or 5 characters of their prose, candidates from MinHash bands and winnowing
together, acceptance with the block of a small text in a large one, families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gram_sets as GS
from ..operators import prose_families as PF
from ..operators import similarity as S
from ..operators.graph import connected
from ..operators.scale import cut, release, spread
from ..tables import table

#: Fingerprints of more sections than this give no candidates: sections that share nothing rarer come from the bands.
POSTINGS = 40
#: A section is numbered by its document and its place in it.
PLACES = 1 << 20


def units(spark, d: str) -> DataFrame:
    """(id, doc_id, start_line, end_line, norm, lines) of the sections of eight words or more."""
    u = sections(documents(spark, d)).filter(T.prose_words(F.col("norm")) >= 8)
    return u.select("id", "doc_id", "start_line", "end_line", "norm", lines_of(F.col("raw")).alias("lines"))


def documents(spark, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def sections(docs: DataFrame) -> DataFrame:
    """(id, doc_id, start_line, end_line, raw, norm) of all sections."""
    return PF.sections(docs, "doc_id", "text").select((F.col("doc_id") * PLACES + F.col("unit_no")).alias("id"), "doc_id", "start_line", "end_line",
        "raw", T.normalize_text(F.col("raw")).alias("norm"))


def lines_of(raw: Column) -> Column:
    """The normalised lines that are not blank."""
    return F.filter(F.transform(F.split(raw, "\n"), lambda x: T.normalize_text(x)), lambda x: x != "")


class Prepared:
    """The sections with their texts compressed, and their classes of equal prose."""

    def __init__(self, spark, d: str):
        self.documents = documents(spark, d)
        dense = F.when(F.col("norm").rlike(f"[{T.NOSPACE}]"), T.gram_size(F.col("norm"))).otherwise(5)  # most texts need no more than one look
        u = cut(GS.pack(sections(self.documents).drop("raw").withColumn("k", dense), "norm").filter("words >= 8"))
        self.units = cut(u.select("id", "doc_id", "start_line", "end_line"))
        self.classes = cut(S.classes(u, "id", F.col("h")))
        copies = self.classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
        reps = u.select(F.col("id").alias("class_id"), "k", "z", "n1").join(copies, "class_id")
        self.reps = cut(reps.select("class_id", "copies", "k", "z", "n1"))
        release(u)
        GS.free()
        self.most = min(max(8, self.reps.count() // 25), POSTINGS)

    def candidates(self) -> DataFrame:
        norms = cut(GS.text_of(self.reps, "class_id", "norm"))
        return S.candidates(S.char_sets(norms), cut(S.winnow(norms)), self.most)

    def lines(self, pairs: DataFrame) -> DataFrame:
        """(class_id, lines) of the ends of `pairs`, from the documents that hold them."""
        ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct())
        docs = self.documents.join(ends.select(F.floor(F.col("class_id") / PLACES).alias("doc_id")).distinct(), "doc_id", "left_semi")
        raw = sections(docs).select(F.col("id").alias("class_id"), "raw").join(ends, "class_id", "left_semi")
        return cut(raw.select("class_id", lines_of(F.col("raw")).alias("lines")))

    def accepted(self) -> tuple[DataFrame, DataFrame, int]:
        """(accepted pairs with their figures, (class_id, size, copies, own) of the sets, the number of sections).
        The texts are deleted when their sets are made."""
        n = self.classes.count()
        reps = spread(self.reps)
        sets, by_number = GS.sets_of(reps, cut(GS.counts(reps, self.most)), n)
        figures = cut(GS.union(sets).select("class_id", "size", "copies", "own"))
        release(self.reps)
        GS.free()
        j = GS.accepted(sets, by_number, n)
        return cut(S.with_block(j, self.lines(j.filter("small_in_large")))), figures, n


def sec_candidates(spark, d):
    """Pairs of sections that a band or enough rare fingerprints propose."""
    return Prepared(spark, d).candidates()


def sec_pairs(spark, d):
    p, _, _ = Prepared(spark, d).accepted()
    return p.select("a", "b", "shared", *(F.round(c, 6).alias(c) for c in ("jaccard", "containment", "cosine", "commonness", "score")))


def sec_families(spark, d):
    """Families of sections of equal or nearly equal prose."""
    x = Prepared(spark, d)
    pairs, sets, _ = x.accepted()
    members = x.classes.join(x.units.select("id", "doc_id", "start_line", "end_line"), "id")
    return PF.unit_families(members, sets, pairs, connected(pairs.filter("score >= 0.7").select("a", "b")), x.lines(pairs))


def md_candidate_recall(spark, d):
    """Of all pairs of documents that are accepted, found exactly, how many the bands
    propose, how many the winnowing index, and how many the two together."""
    from . import prose

    cls, sets, pairs = prose.accepted(spark, d)
    fps = cut(S.winnow(prose.texts_of(spark, d, cls)))
    near = S.bucket_pairs(S.bands(S.signatures(sets)), ["band", "key"], "class_id").withColumn("near", F.lit(1))
    rare = S.shared_rare(fps, "fps", 3, min(max(8, fps.count() // 25), POSTINGS)).select("a", "b", F.lit(1).alias("rare"))
    j = pairs.select("a", "b").join(near, ["a", "b"], "left").join(rare, ["a", "b"], "left")
    return j.agg(F.count(F.lit(1)).alias("accepted"), F.count("near").alias("by_bands"), F.count("rare").alias("by_winnowing"),
        F.count(F.coalesce("near", "rare")).alias("by_either"))


QUERIES = {f.__name__: f for f in (sec_candidates, sec_pairs, sec_families, md_candidate_recall)}

_PERM = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(S.permutations()))
_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_UNITS = f"""{PF.UNITS_SQL},
un AS (SELECT doc_id * {PLACES} + unit_no AS id, doc_id, start_line, end_line, norm FROM uw WHERE n_words >= 8),
cls AS (SELECT *, min(id) OVER (PARTITION BY norm) AS class_id, count(*) OVER (PARTITION BY norm) AS copies FROM un),
reps AS (SELECT class_id, copies, norm, CASE WHEN length(regexp_replace(norm, '[^\\pL]', '', 'g')) > 0 AND length(regexp_replace(norm,
  '[^{T.NOSPACE}]', '', 'g')) * 100 > length(regexp_replace(norm, '[^\\pL]', '', 'g')) * 30 THEN 3 ELSE 5 END AS k FROM cls WHERE id = class_id),
gr AS (SELECT DISTINCT class_id, copies, {_HASH.format("g")} AS g FROM (SELECT class_id, copies, unnest(CASE WHEN length(norm) < k THEN [norm] ELSE
  list_transform(range(1, length(norm) - k + 2), lambda i: substr(norm, i, k)) END) AS g FROM reps)),
sz AS (SELECT class_id, any_value(copies) AS copies, count(*) AS size FROM gr GROUP BY class_id)"""
_CAND = f"""{_UNITS},
perm(i, a, b) AS (VALUES {_PERM}),
sig AS (SELECT class_id, i, min((a * (g % {S.PRIME}) + b) % {S.PRIME}) AS m FROM gr, perm GROUP BY class_id, i),
bk AS (SELECT class_id, i // 4 AS band, string_agg(m, ',' ORDER BY i) AS key FROM sig GROUP BY class_id, i // 4),
bs AS (SELECT band, key, count(*) AS n, min(class_id) AS first FROM bk GROUP BY ALL HAVING count(*) > 1),
hh AS (SELECT class_id, list_transform(CASE WHEN length(norm) < 5 THEN [norm] ELSE list_transform(range(1, length(norm) - 3), lambda i: substr(norm,
  i, 5)) END, lambda x: {_HASH.format("x")}) AS h FROM reps),
fp AS (SELECT DISTINCT class_id, unnest(CASE WHEN len(h) < 4 THEN [list_min(h)] ELSE list_transform(range(1, len(h) - 2), lambda i: list_min(h[i : i +
  3])) END) AS f FROM hh),
fd AS (SELECT f FROM fp GROUP BY f HAVING count(*) BETWEEN 2 AND (SELECT least(greatest(8, count(*) // 25), {POSTINGS}) FROM reps)),
fr AS (SELECT class_id, f FROM fp JOIN fd USING (f)),
cand AS (
  SELECT x.class_id AS a, y.class_id AS b FROM bk x JOIN bk y USING (band, key) JOIN bs USING (band, key) WHERE n <= {S.BUCKET} AND x.class_id <
  y.class_id
  UNION SELECT first, class_id FROM bk JOIN bs USING (band, key) WHERE n > {S.BUCKET} AND class_id > first
  UNION SELECT p, class_id FROM (SELECT class_id, lag(class_id) OVER (PARTITION BY band, key ORDER BY class_id) AS p FROM bk JOIN bs USING (band, key)
  WHERE n > {S.BUCKET}) WHERE p IS NOT NULL
  UNION SELECT x.class_id, y.class_id FROM fr x JOIN fr y ON x.f = y.f AND x.class_id < y.class_id GROUP BY x.class_id, y.class_id HAVING count(*) >=
  3)"""
_PAIRS = f"""{_CAND},
nn AS (SELECT sum(copies)::BIGINT AS n FROM sz),
idf AS (SELECT g, sum(copies)::BIGINT AS df, n, ln((n - sum(copies) + 0.5) / (sum(copies) + 0.5) + 1) AS idf FROM gr, nn GROUP BY g, n),
gw AS (SELECT class_id, g, df, n, idf FROM gr JOIN idf USING (g)),
nrm AS (SELECT class_id, sqrt(sum(idf * idf)) AS l, avg(df::DOUBLE / n) AS own FROM gw GROUP BY class_id),
dots AS (SELECT a, b, count(*) AS shared, sum(x.idf * x.idf) AS dot, avg(x.df::DOUBLE / x.n) AS commonness FROM cand JOIN gw x ON x.class_id = a JOIN
  gr y ON y.class_id = b AND y.g = x.g GROUP BY a, b),
sc AS (SELECT a, b, shared, shared::DOUBLE / (p.size + q.size - shared) AS jaccard, shared::DOUBLE / least(p.size, q.size) AS containment, dot / (u.l
  * v.l) AS cosine, commonness, p.size AS sa, q.size AS sb
       FROM dots JOIN sz p ON p.class_id = a JOIN sz q ON q.class_id = b JOIN nrm u ON u.class_id = a JOIN nrm v ON v.class_id = b),
acc AS (SELECT *, CASE WHEN containment >= 0.8 AND containment > cosine THEN containment ELSE cosine END AS score FROM sc),
lna AS (SELECT class_id, list_filter(list_transform(string_split(raw, chr(10)), lambda t: {T.normalize_sql("t")}), lambda t: t <> '') AS l FROM reps
  JOIN (SELECT doc_id * {PLACES} + unit_no AS class_id, raw FROM ur) USING (class_id)),
{PF.BLOCKS_SQL},
ok AS (SELECT acc.* FROM acc WHERE score >= 0.5 AND shared >= 24 AND (NOT (2 * least(sa, sb) < greatest(sa, sb) AND containment >= 0.8 AND containment
  > cosine) OR (a, b) IN (SELECT (a, b) FROM near2)))"""
_FAMILIES = f"""{_PAIRS},
e AS (SELECT a, b FROM ok WHERE score >= 0.7 UNION SELECT b, a FROM ok WHERE score >= 0.7),
reach(v, r) AS (SELECT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v),
lab AS (SELECT class_id, size, copies, own, coalesce(label, class_id) AS family FROM sz JOIN nrm USING (class_id) LEFT JOIN (SELECT v AS class_id,
  min(r) AS label FROM reach GROUP BY v) USING (class_id)),
ev AS (SELECT x.family, (x.copies * y.copies)::DOUBLE AS w, score, commonness, a, b FROM ok JOIN lab x ON x.class_id = a JOIN lab y ON y.class_id = b
  AND y.family = x.family
  UNION ALL SELECT family, copies * (copies - 1) / 2, 1.0, own, class_id, class_id FROM lab WHERE copies > 1 AND size >= 24),
mn AS (SELECT family, sum(w * score) / sum(w) AS score, sum(w * commonness) / sum(w) AS commonness, max((score, a, b)) AS best FROM ev GROUP BY
  family),
ag AS (SELECT family, count(*) AS members, count(DISTINCT doc_id) AS files, count(DISTINCT class_id) AS texts, floor(avg(end_line - start_line +
  1))::BIGINT AS mean_lines, min(id) AS representative FROM cls JOIN lab USING (class_id) GROUP BY family HAVING count(*) >= 2)
SELECT family, members, files, round(score, 6) AS score, round(commonness, 6) AS commonness, texts = 1 AS is_exact, CASE WHEN texts = 1 THEN 'exact'
  WHEN score >= 0.9 THEN 'near-high' WHEN score >= 0.7 THEN 'near-med'
  WHEN (best[2], best[3]) IN (SELECT (a, b) FROM met) THEN 'near-low' ELSE 'partial' END AS tier, texts > 1 AND members >= 8 AND files >= 4 AS
  is_template, (members - 1) * mean_lines AS removable, representative FROM ag JOIN mn USING (family)"""
SQL = {
    "sec_candidates": f"WITH {_CAND} SELECT a, b FROM cand",
    "sec_pairs": f"""WITH {_PAIRS} SELECT a, b, shared::INT AS shared, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment,
  round(cosine, 6) AS cosine, round(commonness, 6) AS commonness, round(score, 6) AS score FROM ok""",
    "sec_families": f"WITH RECURSIVE {_FAMILIES}",
}
