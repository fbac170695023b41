"""Registered queries over source files, evaluation, functions and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as V
from ..functions import text as T
from ..operators import align, anchors, metrics, ranking, runs, scoring, similarity
from ..operators import code as C
from ..operators import features as X
from ..operators import spans as SP
from ..operators.scale import cut
from ..tables import table


def files(spark, d) -> DataFrame:
    return table(spark, d, "source_files")


def code_languages(spark, d):
    """Files, bytes and lines per language of the extension."""
    n = F.size(F.split("src", "\n"))
    return files(spark, d).groupBy(T.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"),
        F.sum("n_bytes").alias("bytes"), F.sum(n).alias("lines"))


def code_paths(spark, d):
    """What a path says about a file."""
    p = F.col("path")
    return files(spark, d).select("file_id", T.is_test_path(p).alias("test"), T.is_generated_path(p).alias("generated"),
        T.is_dependency_path(p).alias("dependency"), T.module_of(p).alias("module"))


def code_declarations(spark, d):
    return files(spark, d).select("file_id", F.round(T.declaration_share(F.col("src")), 6).alias("share"))


def code_excluded(spark, d):
    """Files that pass the exclude globs."""
    return files(spark, d).filter(~F.col("path").rlike(T.glob_regex("**/vendor/**")) & ~F.col("path").rlike(T.glob_regex("**/*.min.js")) & ~F.col("path").rlike(T.glob_regex("gen/**"))).select("file_id")


def code_latest(spark, d):
    """Of a file scanned several times the last scan."""
    w = Window.partitionBy("repo", "path").orderBy(F.col("scanned_at").desc(), F.col("file_id").desc())
    return files(spark, d).withColumn("r", F.row_number().over(w)).filter("r = 1").select("repo", "path", "file_id")


def code_runs(spark, d):
    return runs.shared_runs(runs.line_windows(files(spark, d), "file_id", T.language_of(F.col("path")), "src"))


def code_line_idf(spark, d):
    """Files that hold a significant line, per language."""
    lines = F.array_distinct(F.filter(F.transform(F.split("src", "\n"), lambda x: F.trim(x)), lambda x: ~T.is_trivial_line(x)))
    x = files(spark, d).select(T.language_of(F.col("path")).alias("language"), F.explode(lines).alias("line"))
    return x.groupBy("language", "line").agg(F.count(F.lit(1)).alias("df"))


def code_py_units(spark, d):
    """Functions and classes of Python files with their features."""
    return C.python_units(files(spark, d)).drop("shapes")


def code_py_clones(spark, d):
    """Python units of equal normalised tree (names and literals apart)."""
    return C.exact_clones(C.python_units(files(spark, d)))


def code_py_near(spark, d):
    """Python units whose multisets of tree shapes are alike by 0.7 or more."""
    return C.near_clones(C.python_units(files(spark, d)))


def _features(spark, d, slim: bool = False) -> DataFrame:
    return cut(X.python_features(files(spark, d), slim))


def code_features(spark, d):
    """Python units, blocks included, with the sizes of their features."""
    sizes = ("value", "shapes", "anchors", "returns", "cond_sinks", "calls", "literals")
    return X.python_features(files(spark, d)).select("unit_id", "kind", "name", "start_line", "end_line", "token_count",
        *(F.size(c).alias(f"n_{c}") for c in sizes), "pure_single_return", "exact_safe")


def code_anchor_pairs(spark, d):
    """Units that share a rare part of some weight."""
    p = anchors.rare_anchor_pairs(_features(spark, d))
    return p.select("a", "b", "weight", F.round(anchors.anchor_score(F.col("weight")), 6).alias("score"))


def code_value_classes(spark, d):
    """Units with the same values."""
    return anchors.value_classes(_features(spark, d))


def code_reinvented(spark, d):
    """Units that write out what a helper already returns."""
    return anchors.reinvented(X.with_called_returns(_features(spark, d, slim=True)))


def code_abstractions(spark, d):
    """Groups of units that differ in the literal at one place only."""
    u = _features(spark, d).select(F.col("shape").alias("family_id"), F.lit("python").alias("lang"), "kind", "literals")
    return anchors.abstraction(u)


def code_pair_scores(spark, d):
    """Pairs of units with the score of every channel."""
    return X.scored_pairs(_features(spark, d)).select("a", "b", *(F.round(c, 6).alias(c) for c in ("exact", "near", "strict", "score")))


def code_witnesses(spark, d):
    """Why the units of a group of equal shape belong together."""
    u = _features(spark, d)
    g = u.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return scoring.group_witness(u.join(g, "shape").select(F.col("shape").alias("group_id"), "unit_id", "value", "shapes",
        F.transform("anchors", lambda x: x["hash"]).alias("anchors"), F.col("exact_safe").alias("safe")))


def code_enclosing(spark, d):
    """The smallest Markdown section around each matched span."""
    inner = table(spark, d, "witness_refs").filter("a_path IS NOT NULL").select(F.col("witness_id").alias("id"), F.col("a_path").alias("file"),
        F.col("a_start").alias("start"), F.col("a_end").alias("end")).distinct()
    outer = table(spark, d, "md_units").select(F.col("path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"),
        F.col("unit_id").alias("name"))
    return SP.enclosing(inner, outer)


def md_witness(spark, d):
    """The best local alignment of the lines of near copies."""
    from . import prose

    cls, sets = prose.sets_of(spark, d, quick=True)
    links = similarity.jaccard_links(sets).select("a", "b")
    t = prose.docs(spark, d)
    j = links.join(t.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")),
        "a").join(t.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    return align.line_witness(j)


def _graded(spark, d) -> DataFrame:
    fam = ranking.family_rows(table(spark, d, "families"))
    g = table(spark, d, "review_labels").filter("grade IS NOT NULL").groupBy("family_id").agg((F.avg("grade") >= 1.5).alias("good"))
    return fam.join(g, "family_id")


def eval_ranking(spark, d):
    return metrics.ranking(_graded(spark, d).select("score", "good"))


def eval_recall(spark, d):
    return metrics.recall_at(_graded(spark, d).select("score", "good"), 0.8)


def eval_pairs(spark, d):
    """Witness pairs against the pairs of paths that families hold. A pair is right if
    one family names both; how many pairs a family of n holds is counted, not listed."""
    w = table(spark, d, "witness_refs").filter("a_path IS NOT NULL AND b_path IS NOT NULL AND a_path <> b_path").select(F.least("a_path",
        "b_path").alias("a"), F.greatest("a_path", "b_path").alias("b")).distinct()
    p = F.array_distinct(F.expr("filter(transform(members, m -> m.path), p -> p IS NOT NULL)"))
    fam = ranking.family_rows(table(spark, d, "families")).select("family_id", p.alias("p")).filter("size(p) > 1")
    held = fam.select("family_id", F.explode("p").alias("path"))
    side = lambda k: held.select("family_id", F.col("path").alias(k))
    return metrics.held_pairs(w, side("a"), side("b"), fam.agg(F.coalesce(F.sum(F.size("p") * (F.size("p") - 1) / 2), F.lit(0)).cast("bigint").alias("gold")))


def eval_soundness(spark, d):
    """Headings as fingerprints of the kind of a unit."""
    return metrics.soundness(table(spark, d, "md_units").filter("heading IS NOT NULL").select(F.col("unit_id").alias("id"),
        F.col("heading").alias("fp"), F.col("kind").alias("behaviour")))


def eval_completeness(spark, d):
    return metrics.completeness(table(spark, d, "md_units").filter("heading IS NOT NULL").select(F.col("heading").alias("fp"), F.col("kind").alias("behaviour")))


def value_integers(spark, d):
    """Integer functions over line items, zero divisors included."""
    a, b = (F.col("l_orderkey").cast("bigint") - 30000), (F.col("l_linenumber").cast("bigint") - 3)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", V.trunc_div(a, b).alias("q"), V.floor_div(a, b).alias("fq"), V.trunc_mod(a, b).alias("m"),
            V.floor_mod(a, b).alias("fm"), V.value_and(a, b).alias("x_and"), V.value_or(b, a).alias("x_or"),
        V.clamp(a, F.lit(-100).cast("bigint"), F.lit(100).cast("bigint")).alias("c"), V.to_uint32(a).alias("u"), V.to_int32(a).alias("i"),
    )


def value_wrapping(spark, d):
    a = F.col("l_orderkey").cast("bigint") * 15000000000 + 7
    b = F.col("l_partkey").cast("bigint") * 400000000000 + 11
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.wrap_add(V.wrap_mul(a, b), b).alias("x"))


def value_lists(spark, d):
    """List functions over the parts of each order."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_partkey").cast("bigint"))).alias("xs"))
    return g.select(
        "l_orderkey", V.list_sum(F.col("xs")).alias("s"), F.array_min("xs").alias("lo"), F.array_max("xs").alias("hi"),
            F.size(V.zip_short(F.col("xs"), F.slice("xs", 2, 100))).alias("pairs"),
        V.list_sum(F.filter("xs", lambda x: x % 2 == 0)).alias("even"), V.list_sum(F.transform("xs", lambda x: x * 2)).alias("twice"),
            F.exists("xs", lambda x: x > 1000).alias("some"), F.forall("xs", lambda x: x > 10).alias("every"),
        V.reduce_list(F.col("xs"), lambda a, x: F.greatest(a, x)).alias("top"),
            F.size(V.list_range(F.lit(0).cast("bigint"), F.size("xs").cast("bigint"), F.lit(2).cast("bigint"))).alias("half"),
    )


def rel_pricing(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(rev), 2).alias("revenue"),
        F.count(F.lit(1)).alias("n"))


def rel_nation_revenue(spark, d):
    o, c, n, r, li = (table(spark, d, t) for t in ("orders", "customer", "nation", "region", "lineitem"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def rel_sessions(spark, d):
    """Sessions per user: a gap of more than half an hour begins a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("new",
        F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) > 1_800_000_000).cast("int"), F.lit(1)))
    e = e.withColumn("s", F.sum("new").over(w))
    return e.groupBy("user_id").agg(F.max("s").alias("sessions"), F.count(F.lit(1)).alias("events"))


QUERIES = {f.__name__: f for f in (
    code_languages, code_paths, code_declarations, code_excluded, code_latest, code_runs, code_line_idf, code_py_units, code_py_clones, code_py_near,
    code_features, code_anchor_pairs, code_value_classes, code_reinvented, code_abstractions, code_pair_scores, code_witnesses, code_enclosing, md_witness,
    eval_ranking, eval_recall, eval_pairs,
    eval_soundness, eval_completeness, value_integers, value_wrapping, value_lists, rel_pricing, rel_nation_revenue, rel_sessions,
)}

_LANG = "CASE regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items()) + " END"
_TEST = f"regexp_matches(lower(path), '{T.TEST_PATH}')"


RUNS_SQL = rf"""WITH l AS (SELECT file_id AS file, {_LANG} AS lang, list_filter(list_transform(string_split(src, chr(10)), lambda x:
  trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'), ' ')), lambda y: NOT {T.is_trivial_sql('y')}) AS l FROM source_files),
w AS (SELECT file, lang, i - 1 AS pos, md5(array_to_string(l[i : i + 4], chr(10))) AS g FROM (SELECT file, lang, l, unnest(range(1, len(l) - 3)) AS i
  FROM l WHERE len(l) >= 5)),
f AS (SELECT lang, g, min((file, pos)) AS f FROM w GROUP BY lang, g HAVING count(*) > 1),
j AS (SELECT f[1] AS a, file AS b, f[2] AS a_pos, pos AS b_pos, f[2] - pos AS d FROM w JOIN f ON w.g = f.g AND w.lang IS NOT DISTINCT FROM f.lang
  WHERE f[1] <> file),
i AS (SELECT *, b_pos - row_number() OVER (PARTITION BY a, b, d ORDER BY b_pos) AS i FROM j),
runs AS (SELECT a, b, min(a_pos) AS a_pos, min(b_pos) AS b_pos, count(*) + 4 AS lines FROM i GROUP BY a, b, d, i HAVING count(*) + 4 >= 6)
"""
_GRADED = """WITH fr AS (SELECT * FROM families WHERE family_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY loaded_at DESC
  NULLS LAST, reported_at DESC NULLS LAST) = 1),
g AS (SELECT family_id, avg(grade) >= 1.5 AS good FROM review_labels WHERE grade IS NOT NULL GROUP BY family_id),
s AS (SELECT score, good FROM fr JOIN g USING (family_id) WHERE score IS NOT NULL AND NOT isnan(score)),
v AS (SELECT score, sum(good::INT) AS g, sum((NOT good)::INT) AS b FROM s GROUP BY score),
c AS (SELECT *, sum(g) OVER (ORDER BY score DESC) AS cg, sum(b) OVER (ORDER BY score DESC) AS cb FROM v)"""
SQL = {
    "code_languages": f"""SELECT {_LANG} AS language, count(*) AS files, sum(n_bytes)::BIGINT AS bytes, sum(len(string_split(src, chr(10))))::BIGINT
  AS lines FROM source_files GROUP BY 1""",
    "code_paths": rf"""SELECT file_id, {_TEST} AS test, regexp_matches(lower(path), '{T.FOREIGN_PATH}') AS generated, regexp_matches(lower(path),
  '(^|/)(node_modules|vendor|third_party|external|bower_components|site-packages|dist|build)/') AS dependency, regexp_extract(path, '^(.*)/[^/]*$', 1)
  AS module FROM source_files""",
    "code_declarations": r"""WITH l AS (SELECT file_id, list_filter(list_transform(string_split(src, chr(10)), lambda x: trim(x, ' ')), lambda x: x <>
  '') AS l FROM source_files)
SELECT file_id, CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x,
  '^(import |from |#include|use |pub use |require|package |using |export \* from|export \{)')))::DOUBLE / len(l), 6) WHEN l IS NOT NULL THEN 0.0 END AS share FROM l""",
    "code_excluded": r"""SELECT file_id FROM source_files WHERE NOT regexp_full_match(path, '(.*/)?vendor/.*') AND NOT regexp_full_match(path,
  '(.*/)?[^/]*\.min\.js') AND NOT path LIKE 'gen/%'""",
    "code_latest": "SELECT repo, path, arg_max(file_id, (scanned_at, file_id)) AS file_id FROM source_files GROUP BY repo, path",
    "code_runs": RUNS_SQL + "SELECT a, b, a_pos, b_pos, lines FROM runs",
    "code_line_idf": rf"""SELECT language, line, count(*) AS df FROM (SELECT DISTINCT file_id, {_LANG} AS language, trim(unnest(string_split(src,
  chr(10))), ' ') AS line FROM source_files) WHERE NOT {T.is_trivial_sql('line')} GROUP BY ALL""",
    "code_enclosing": """WITH i AS (SELECT DISTINCT witness_id AS id, a_path AS file, a_start AS s, a_end AS e FROM witness_refs WHERE a_path IS NOT
  NULL AND a_end >= a_start)
SELECT id, min((end_line - start_line, start_line, unit_id))[3] AS outer FROM i JOIN md_units u ON u.path = i.file AND u.start_line <= s AND e <=
  u.end_line GROUP BY id""",
    "eval_ranking": f"""{_GRADED} SELECT round(sum(b * (cg - g / 2.0)) / (sum(g) * sum(b)), 6) AS auc, round(sum(g * cg::DOUBLE / (cg + cb)) / sum(g),
  6) AS average_precision, sum(g)::BIGINT AS positives, sum(b)::BIGINT AS negatives FROM c""",
    "eval_recall": f"""{_GRADED} SELECT 0.8::DOUBLE AS precision, round(coalesce(max(CASE WHEN cg::DOUBLE / (cg + cb) >= 0.8 THEN cg ELSE 0
  END)::DOUBLE / sum(g), 0.0), 6) AS recall FROM c""",
    "eval_pairs": """WITH w AS (SELECT DISTINCT least(a_path, b_path) AS a, greatest(a_path, b_path) AS b FROM witness_refs WHERE a_path IS NOT NULL
  AND b_path IS NOT NULL AND a_path <> b_path),
fr AS (SELECT * FROM families WHERE family_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY loaded_at DESC NULLS LAST,
  reported_at DESC NULLS LAST) = 1),
f AS (SELECT family_id, list_distinct(list_filter(list_transform(members, lambda m: m.path), lambda p: p IS NOT NULL)) AS p FROM fr),
h AS (SELECT family_id, unnest(p) AS path FROM f WHERE len(p) > 1),
m AS (SELECT a, b, count(*) AS k FROM w JOIN h x ON x.path = a JOIN h y ON y.path = b AND y.family_id = x.family_id GROUP BY a, b),
n AS (SELECT (SELECT count(*) FROM w) AS found, (SELECT coalesce(sum(len(p) * (len(p) - 1) // 2), 0)::BIGINT FROM f) AS gold, (SELECT count(*) FROM m)
  AS hits, (SELECT coalesce(sum(k), 0)::BIGINT FROM m) AS held)
SELECT found, gold, hits, held, round(hits::DOUBLE / found, 6) AS precision, round(held::DOUBLE / gold, 6) AS recall, round(2 * (hits::DOUBLE / found)
  * (held::DOUBLE / gold) / (hits::DOUBLE / found + held::DOUBLE / gold), 6) AS f1 FROM n""",
    "eval_soundness": """WITH u AS (SELECT unit_id, heading, kind, count(*) OVER (PARTITION BY heading) AS n, first_value(kind) OVER (PARTITION BY
  heading ORDER BY unit_id) AS b0 FROM md_units WHERE heading IS NOT NULL)
SELECT heading AS fp, any_value(n) AS n, sum((kind <> b0)::INT)::BIGINT AS violations FROM u WHERE n > 1 GROUP BY heading""",
    "eval_completeness": """WITH t AS (SELECT kind, heading, count(*) AS k FROM md_units WHERE heading IS NOT NULL GROUP BY ALL), p AS (SELECT kind,
  sum(k)::BIGINT AS n, sum(k * (k - 1) // 2)::BIGINT AS met FROM t GROUP BY kind)
SELECT count(*) AS behaviours, sum(n * (n - 1) // 2)::BIGINT AS pairs, sum(met)::BIGINT AS met FROM p""",
    "value_integers": """WITH v AS (SELECT l_orderkey, l_linenumber, l_orderkey::BIGINT - 30000 AS a, l_linenumber::BIGINT - 3 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN b <> 0 THEN a // b END AS q, CASE WHEN b <> 0 THEN a // b - CASE WHEN a % b <> 0 AND (a < 0) <> (b < 0)
  THEN 1 ELSE 0 END END AS fq, CASE WHEN b <> 0 THEN a % b END AS m,
CASE WHEN b <> 0 THEN ((a % b) + b) % b END AS fm, CASE WHEN a <> 0 THEN b ELSE a END AS x_and, CASE WHEN b <> 0 THEN b ELSE a END AS x_or,
  least(greatest(a, -100), 100) AS c, a & 4294967295 AS u,
CASE WHEN (a & 4294967295) >= 2147483648 THEN (a & 4294967295) - 4294967296 ELSE a & 4294967295 END AS i FROM v""",
    "value_wrapping": """WITH v AS (SELECT l_orderkey, l_linenumber, l_orderkey::HUGEINT * 15000000000 + 7 AS a, l_partkey::HUGEINT * 400000000000 +
  11 AS b FROM lineitem),
m AS (SELECT *, ((a % 18446744073709551616) * (b % 4294967296) + ((a % 4294967296) * (b // 4294967296) % 4294967296) * 4294967296 + b) %
  18446744073709551616 AS r FROM v)
SELECT l_orderkey, l_linenumber, (CASE WHEN r >= 9223372036854775808 THEN r - 18446744073709551616 ELSE r END)::BIGINT AS x FROM m""",
    "value_lists": """WITH g AS (SELECT l_orderkey, list_sort(list(l_partkey::BIGINT)) AS xs FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, list_sum(xs)::BIGINT AS s, list_min(xs) AS lo, list_max(xs) AS hi, (len(xs) - 1)::INT AS pairs, coalesce(list_sum(list_filter(xs,
  lambda x: x % 2 = 0)), 0)::BIGINT AS even, (list_sum(xs) * 2)::BIGINT AS twice,
list_max(xs) > 1000 AS some, list_min(xs) > 10 AS every, list_max(xs) AS top, ((len(xs) + 1) // 2)::INT AS half FROM g""",
    "rel_pricing": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS
  revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "rel_nation_revenue": """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON
  l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL""",
    "rel_sessions": """WITH e AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000)::INT, 1) AS new FROM events WINDOW w AS
  (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e) SELECT user_id, max(s)::BIGINT AS sessions, count(*) AS
  events FROM s GROUP BY user_id""",
}
