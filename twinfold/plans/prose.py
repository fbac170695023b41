"""Registered queries over `documents`: normalisation, units, similarity joins,
pair scores, families of near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import prose_families as PF
from ..operators import similarity as S
from ..operators.graph import connected
from ..operators.scale import cut, spread
from ..tables import table


def docs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def simple_norm(c):
    return T.squeeze(F.lower(c))


def md_normalize(spark, d):
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


def md_words(spark, d):
    w = T.words(simple_norm(F.col("text")))
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"))


def md_gram_size(spark, d):
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", T.gram_size(F.lower("text")).alias("gram_size"))


def md_ngrams(spark, d):
    """Character grams per document: how many, and how many distinct ones."""
    n = simple_norm(F.col("text"))
    g = T.char_ngrams(F.col("n"), 5)
    return docs(spark, d).filter("text IS NOT NULL").select("doc_id", n.alias("n")).select("doc_id", F.size(g).alias("n_grams"),
        F.size(F.array_distinct(g)).alias("n_distinct"))


def md_units(spark, d):
    """Heading-rooted sections, what stands before the first heading, or one unit for
    a text without headings; of eight words at least."""
    u = PF.units(spread(docs(spark, d)), "doc_id", "text")
    return u.select("doc_id", "unit_no", "kind", "heading", "start_line", "end_line", "n_words", F.md5("norm").alias("norm_md5"))


def md_code(spark, d):
    return docs(spark, d).filter("text LIKE '%```%'").select("doc_id", F.md5(T.extract_code(F.col("text"))).alias("code_md5"))


def norm_text():
    return simple_norm(F.col("text"))


def reps(spark, d):
    return S.classes(docs(spark, d), "doc_id", norm_text())


def texts_of(spark, d, cls):
    """The texts of the representatives, over all cores."""
    return spread(docs(spark, d)).transform(lambda x: S.representatives(cls, x, "doc_id", norm_text()))


def sets_of(spark, d, quick=False):
    cls = cut(reps(spark, d))
    return cls, S.word_shingles(texts_of(spark, d, cls), quick=quick)


def md_exact_classes(spark, d):
    cls = reps(spark, d)
    size = cls.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_copies"))
    return cls.select("id", "class_id").join(size, "class_id").select(F.col("id").alias("doc_id"), "class_id", "n_copies")


def md_near_dups(spark, d):
    cls, sets = sets_of(spark, d, quick=True)
    return S.per_document(cls, cut(S.jaccard_links(sets))).withColumnRenamed("id", "doc_id")


def md_jaccard_links(spark, d):
    _, sets = sets_of(spark, d, quick=True)
    return S.jaccard_links(sets).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


def md_lsh_candidates(spark, d):
    _, sets = sets_of(spark, d)
    return S.bucket_pairs(S.bands(S.signatures(sets)), ["band", "key"], "class_id")


def md_minhash_estimate(spark, d):
    _, sets = sets_of(spark, d)
    sig = cut(S.signatures(sets))
    return S.estimate(S.bucket_pairs(S.bands(sig), ["band", "key"], "class_id"), sig).select("a", "b", F.round("estimate", 6).alias("estimate"))


def md_winnow_candidates(spark, d):
    cls = cut(reps(spark, d))
    fps = cut(S.winnow(texts_of(spark, d, cls)))
    return S.shared_rare(fps, "fps", 3, min(max(8, fps.count() // 25), 40))  # bounded posting lists at any size


def md_idf(spark, d):
    _, sets = sets_of(spark, d)
    return S.idf_table(sets).select("g", "df", F.round("idf", 6).alias("idf"))


def lines_of(spark, d):
    """(class_id, lines): the normalised lines of the documents that are not blank."""
    return docs(spark, d).filter("text IS NOT NULL").select(F.col("doc_id").alias("class_id"),
        F.filter(F.transform(F.split("text", "\n"), lambda x: T.normalize_text(x)), lambda x: x != "").alias("lines"))


def accepted(spark, d):
    """(cls, sets, pairs with score, cosine, containment, shared, jaccard, commonness):
    all accepted pairs of the corpus, not only those that share a MinHash band."""
    cls, sets = sets_of(spark, d, quick=True)
    w, n = S.weighted(sets)
    w = cut(w)
    j = S.pair_stats(cut(S.accept_candidates(w, n)), w, n)
    score, ok = S.accept(F.col("cosine"), F.col("containment"), F.col("shared"))
    p = cut(j.filter(ok).withColumn("score", score))
    return cls, sets, cut(S.with_block(p, lines_of(spark, d)))


def md_accept_pairs(spark, d):
    _, _, p = accepted(spark, d)
    return p.select("a", "b", "shared", *(F.round(c, 6).alias(c) for c in ("jaccard", "containment", "cosine", "commonness", "score")))


def md_components(spark, d):
    """(doc_id, component): strong links only (score 0.7 or more)."""
    cls, _, p = accepted(spark, d)
    lab = connected(p.filter("score >= 0.7").select("a", "b"))
    return cls.join(lab.select(F.col("v").alias("class_id"), "label"), "class_id", "left").select(F.col("id").alias("doc_id"),
        F.coalesce("label", "class_id").alias("component"))


def md_families(spark, d):
    cls, _, p = accepted(spark, d)
    lab = connected(p.filter("score >= 0.7").select("a", "b"))
    return PF.families(docs(spark, d), cls, p, lab)


def md_top_families(spark, d):
    return PF.ranked(md_families(spark, d)).orderBy("rank").limit(20)


def md_line_idf(spark, d):
    """Share of the documents that hold a line, and the weight made of it."""
    x = docs(spark, d).filter("text IS NOT NULL")
    lines = x.select("doc_id", F.explode(F.array_distinct(F.transform(T.numbered_lines(F.col("text")), lambda s: s["text"]))).alias("line"))
    n = x.agg(F.count(F.lit(1)).alias("n"))
    df = lines.filter(~T.is_trivial_line(F.col("line"))).groupBy("line").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))  # n is one row
    f = F.col("df") / F.col("n")
    w = F.when(F.col("n") <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.60 - f) / 0.35)))
    return df.select("line", "df", F.round(w, 6).alias("weight"))


def md_language_share(spark, d):
    """Documents per feed and language with its share of the feed."""
    g = docs(spark, d).groupBy("source", F.lower(F.coalesce("lang", F.lit("?"))).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


QUERIES = {f.__name__: f for f in (
    md_normalize, md_words, md_gram_size, md_ngrams, md_units, md_code, md_exact_classes, md_near_dups, md_jaccard_links, md_lsh_candidates,
        md_minhash_estimate, md_winnow_candidates,
    md_idf, md_accept_pairs, md_components, md_families, md_top_families, md_line_idf, md_language_share,
)}

# ---- SQL -----------------------------------------------------------------

_SQUEEZE = r"trim(regexp_replace({}, '[ \t\r\n\f]+', ' ', 'g'), ' ')"
_NORM = _SQUEEZE.format("lower(text)")
_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
_CLS = f"""
n0 AS (SELECT doc_id AS id, {_NORM} AS norm FROM documents WHERE text IS NOT NULL),
cls AS (SELECT id, min(id) OVER (PARTITION BY norm) AS class_id, norm FROM n0 WHERE norm <> ''),
reps AS (SELECT class_id, norm FROM cls WHERE id = class_id)"""
_SETS = f"""{_CLS},
w0 AS (SELECT class_id, regexp_extract_all(norm, '{_WORD}') AS w FROM reps),
gr AS (SELECT DISTINCT class_id, ('0x' || substr(md5(array_to_string(w[i : i + 4], ' ')), 1, 15))::BIGINT AS g
       FROM (SELECT class_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w0 WHERE len(w) > 0)),
sz AS (SELECT class_id, count(*) AS size FROM gr GROUP BY class_id)"""
_LINKS = f"""{_SETS},
sh AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS shared FROM gr x JOIN gr y ON x.g = y.g AND x.class_id < y.class_id GROUP BY ALL),
links AS (SELECT a, b, shared, shared::DOUBLE / (p.size + q.size - shared) AS jaccard FROM sh JOIN sz p ON p.class_id = a JOIN sz q ON q.class_id = b
          WHERE shared::DOUBLE / (p.size + q.size - shared) >= 0.8)"""
_PERM = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(S.permutations()))
_SIG = f"""{_SETS},
perm(i, a, b) AS (VALUES {_PERM}),
sig AS (SELECT class_id, i, min((a * (g % {S.PRIME}) + b) % {S.PRIME}) AS m FROM gr, perm GROUP BY class_id, i)"""
_LSH = f"""{_SIG},
bk AS (SELECT class_id, i // 4 AS band, string_agg(m, ',' ORDER BY i) AS key FROM sig GROUP BY class_id, i // 4),
bs AS (SELECT band, key, count(*) AS n, min(class_id) AS first FROM bk GROUP BY ALL HAVING count(*) > 1),
cand AS (
  SELECT x.class_id AS a, y.class_id AS b FROM bk x JOIN bk y USING (band, key) JOIN bs USING (band, key) WHERE n <= {S.BUCKET} AND x.class_id <
  y.class_id
  UNION SELECT first, class_id FROM bk JOIN bs USING (band, key) WHERE n > {S.BUCKET} AND class_id > first
  UNION SELECT p, class_id FROM (SELECT class_id, lag(class_id) OVER (PARTITION BY band, key ORDER BY class_id) AS p FROM bk JOIN bs USING (band, key)
  WHERE n > {S.BUCKET}) WHERE p IS NOT NULL)"""
_ACC = f"""{_SETS},
cand AS (SELECT x.class_id AS a, y.class_id AS b FROM gr x JOIN gr y ON x.g = y.g AND x.class_id < y.class_id GROUP BY ALL HAVING count(*) >= 24),
nn AS (SELECT count(*) AS n FROM sz),
idf AS (SELECT g, count(*) AS df, n, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM gr, nn GROUP BY g, n),
nrm AS (SELECT class_id, sqrt(sum(idf * idf)) AS l FROM gr JOIN idf USING (g) GROUP BY class_id),
dots AS (SELECT a, b, count(*) AS shared, sum(idf * idf) AS dot, avg(df::DOUBLE / n) AS commonness FROM cand JOIN gr x ON x.class_id = a JOIN gr y ON
  y.class_id = b AND y.g = x.g JOIN idf ON idf.g = x.g GROUP BY a, b),
sc AS (SELECT a, b, shared, shared::DOUBLE / (p.size + q.size - shared) AS jaccard, shared::DOUBLE / least(p.size, q.size) AS containment, dot / (u.l
  * v.l) AS cosine, commonness
       FROM dots JOIN sz p ON p.class_id = a JOIN sz q ON q.class_id = b JOIN nrm u ON u.class_id = a JOIN nrm v ON v.class_id = b),
acc AS (SELECT *, CASE WHEN containment >= 0.8 AND containment > cosine THEN containment ELSE cosine END AS score FROM sc),
lna AS (SELECT doc_id AS class_id, list_filter(list_transform(string_split(text, chr(10)), lambda t: {T.normalize_sql('t')}), lambda t: t <> '') AS l
  FROM documents WHERE text IS NOT NULL),
{PF.BLOCKS_SQL},
ok AS (SELECT acc.* FROM acc JOIN sz p ON p.class_id = a JOIN sz q ON q.class_id = b WHERE score >= 0.5 AND shared >= 24
       AND (NOT (2 * least(p.size, q.size) < greatest(p.size, q.size) AND containment >= 0.8 AND containment > cosine) OR (a, b) IN (SELECT (a, b)
  FROM near2)))"""
_COMP = f"""{_ACC},
e AS (SELECT a, b FROM ok WHERE score >= 0.7 UNION SELECT b, a FROM ok WHERE score >= 0.7),
reach(v, r) AS (SELECT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v),
lab AS (SELECT v, min(r) AS label FROM reach GROUP BY v)"""
_LINES = r"""
x AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
ln AS (SELECT DISTINCT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\r]+', ' ', 'g'), ' ') AS line FROM x)"""

SQL = {
    "md_normalize": f"SELECT doc_id, {T.normalize_sql('text')} AS norm FROM documents WHERE text IS NOT NULL",
    "md_units": f"""WITH {PF.UNITS_SQL} SELECT doc_id, unit_no, kind, heading, start_line, end_line, n_words, md5(norm) AS norm_md5 FROM uw WHERE
  n_words >= 8""",
    "md_top_families": f"""WITH RECURSIVE {_COMP}, {PF.FAMILIES_SQL}, tf AS (SELECT * FROM ({PF.FAMILIES_SELECT})) SELECT *, (row_number() OVER (ORDER
  BY is_template, -removable * score, -members, representative))::INT AS rank FROM tf ORDER BY rank LIMIT 20""",
    "md_words": f"""SELECT doc_id, len(w)::INT AS n_words, len(list_distinct(w))::INT AS n_distinct FROM (SELECT doc_id, regexp_extract_all({_NORM},
  '{_WORD}') AS w FROM documents WHERE text IS NOT NULL)""",
    "md_gram_size": f"""SELECT doc_id, CASE WHEN l > 0 AND d * 100 > l * 30 THEN 3 ELSE 5 END AS gram_size FROM (SELECT doc_id,
  length(regexp_replace(lower(text), '[^\\pL]', '', 'g')) AS l, length(regexp_replace(lower(text), '[^{T.NOSPACE}]', '', 'g')) AS d FROM documents
  WHERE text IS NOT NULL)""",
    "md_ngrams": f"""WITH n AS (SELECT doc_id, {_NORM} AS n FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, n, CASE WHEN length(n) = 0 THEN [] WHEN length(n) < 5 THEN [n] ELSE list_transform(range(1, length(n) - 3), lambda i: substr(n,
  i, 5)) END AS g FROM n)
SELECT doc_id, len(g)::INT AS n_grams, len(list_distinct(g))::INT AS n_distinct FROM g""",
    "md_code": """SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '(?s)```[^\\n]*\\n(.*?)```', 1), lambda x: trim(x, ' ')),
  chr(10))) AS code_md5 FROM documents WHERE text LIKE '%```%'""",
    "md_exact_classes": f"WITH {_CLS} SELECT id AS doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS n_copies FROM cls",
    "md_jaccard_links": f"WITH {_LINKS} SELECT a, b, shared, round(jaccard, 6) AS jaccard FROM links",
    "md_near_dups": f"""WITH {_LINKS}, ends AS (SELECT class_id, count(*) AS n FROM (SELECT a AS class_id FROM links UNION ALL SELECT b FROM links)
  GROUP BY class_id)
SELECT id AS doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS n_copies, coalesce(n, 0) AS n_links FROM cls LEFT JOIN ends USING (class_id)""",
    "md_lsh_candidates": f"WITH {_LSH} SELECT a, b FROM cand",
    "md_minhash_estimate": f"""WITH {_LSH} SELECT c.a, c.b, round(avg((x.m = y.m)::INT), 6) AS estimate FROM cand c JOIN sig x ON x.class_id = c.a
  JOIN sig y ON y.class_id = c.b AND y.i = x.i GROUP BY c.a, c.b""",
    "md_winnow_candidates": f"""WITH {_CLS},
h AS (SELECT class_id, CASE WHEN length(norm) < 5 THEN [norm] ELSE list_transform(range(1, length(norm) - 3), lambda i: substr(norm, i, 5)) END AS g
  FROM reps),
hh AS (SELECT class_id, list_transform(g, lambda x: ('0x' || substr(md5(x), 1, 15))::BIGINT) AS h FROM h),
fp AS (SELECT DISTINCT class_id, unnest(CASE WHEN len(h) < 4 THEN [list_min(h)] ELSE list_transform(range(1, len(h) - 2), lambda i: list_min(h[i : i +
  3])) END) AS f FROM hh),
df AS (SELECT f FROM fp GROUP BY f HAVING count(*) BETWEEN 2 AND (SELECT least(greatest(8, count(*) // 25), 40) FROM reps)),
r AS (SELECT class_id, f FROM fp JOIN df USING (f))
SELECT x.class_id AS a, y.class_id AS b, count(*) AS shared FROM r x JOIN r y ON x.f = y.f AND x.class_id < y.class_id GROUP BY ALL HAVING count(*) >=
  3""",
    "md_idf": f"""WITH {_SETS}, nn AS (SELECT count(*) AS n FROM sz) SELECT g, count(*) AS df, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1),
  6) AS idf FROM gr, nn GROUP BY g, n""",
    "md_accept_pairs": f"""WITH {_ACC} SELECT a, b, shared, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment, round(cosine, 6) AS
  cosine, round(commonness, 6) AS commonness, round(score, 6) AS score FROM ok""",
    "md_components": f"WITH RECURSIVE {_COMP} SELECT id AS doc_id, coalesce(label, class_id) AS component FROM cls LEFT JOIN lab ON v = class_id",
    "md_families": f"WITH RECURSIVE {_COMP}, {PF.FAMILIES_SQL} {PF.FAMILIES_SELECT}",
    "md_line_idf": f"""WITH {_LINES}, nn AS (SELECT count(*) AS n FROM x),
df AS (SELECT line, count(*) AS df, any_value(n) AS n FROM ln, nn WHERE NOT {T.is_trivial_sql('line')} GROUP BY line)
SELECT line, df, round(CASE WHEN n <= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, (0.60 - df::DOUBLE / n) / 0.35)) END, 6) AS weight FROM df""",
    "md_language_share": """SELECT source, lower(coalesce(lang, '?')) AS lang, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION
  BY source), 6) AS share FROM documents GROUP BY source, lower(coalesce(lang, '?'))""",
}
