"""Registered queries that check and count: reachability, calibration, precision,
mined literals, exclusions, imports, run spans and their sinks, functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as V
from ..functions import text as T
from ..operators import census as N
from ..operators import lines as L
from ..operators import metrics, runs, spans
from ..operators.scale import cut, spread
from ..operators.similarity import low_shingles
from ..tables import table
from . import prose
from . import query_language as Q
from .families import rows


def files(spark, d) -> DataFrame:
    return table(spark, d, "source_files")


def eval_reachable(spark, d):
    """Of the pairs a family's first member makes with the others, how many lie in two
    sections and how many of these two a witness row matches."""
    m = rows(spark, d).filter("size(members) > 1").select("family_id", F.get("members", F.lit(0)).alias("l"),
        F.posexplode(F.slice("members", 2, 1_000_000)).alias("i", "r"))
    side = lambda s: (F.col(f"{s}.path").alias(f"{s}_file"), F.col(f"{s}.start_line").alias(f"{s}_start"), F.col(f"{s}.end_line").alias(f"{s}_end"))
    gold = m.select(F.concat_ws("/", "family_id", "i").alias("id"), *side("l"), *side("r"))
    u = table(spark, d, "md_units").select(F.col("unit_id").alias("unit"), F.col("path").alias("file"), F.col("start_line").alias("start"),
        F.col("end_line").alias("end"))
    w = table(spark, d, "witness_refs").filter("a_path IS NOT NULL AND b_path IS NOT NULL").select("witness_id",
        *(F.col(c) for c in ("a_path", "a_start", "a_end", "b_path", "b_start", "b_end"))).distinct()
    own = lambda s: spans.overlap_join(w.select("witness_id", F.col(f"{s}_path").alias("file"), F.col(f"{s}_start").alias("start"),
        F.col(f"{s}_end").alias("end")), u.withColumnRenamed("unit", s)).select("witness_id", s)
    return N.reachable(gold, u, own("a").join(own("b"), "witness_id").filter("a <> b").select("a", "b"))


def eval_calibration(spark, d):
    """How often documents of a likeness come from one feed: each with the 32 behind
    it by its smallest gram."""
    docs = prose.docs(spark, d).select("doc_id", prose.norm_text().alias("norm"), "source")
    one = spread(docs.filter("norm IS NOT NULL AND norm <> ''")).select(F.col("doc_id").alias("id"), F.sha2("norm", 256).alias("h"), T.words(F.col("norm")).alias("w"))
    one = cut(low_shingles(one))  # equal texts have the same lowest shingle
    placed = N.blocks(N.numbered(one.groupBy("h").agg(F.min("id").alias("class_id"), F.min("g").alias("g")), "class_id", "g"))
    # the texts are sent, which pack well, and cut into shingles where they meet
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    near = docs.join(placed.withColumnRenamed("k", "doc_id"), "doc_id").repartition(n, "block")
    return N.calibration(N.block_likeness(near.select("block", "i", T.words(F.col("norm")).alias("w"), "source")))


def _found_and_gold(spark, d):
    w = table(spark, d, "witness_refs").filter("a_path IS NOT NULL AND b_path IS NOT NULL AND a_path <> b_path").select(F.col("a_path").alias("a"),
        F.col("b_path").alias("b"), "channel")
    p = F.array_distinct(F.expr("filter(transform(members, m -> m.path), p -> p IS NOT NULL)"))
    star = rows(spark, d).select("tier", p.alias("p")).filter("size(p) > 1").select("tier", F.array_min("p").alias("a"), F.explode("p").alias("b")).filter("a <> b")
    return w, star


def eval_slices(spark, d):
    """Witness pairs against the pairs that families name, per tier of the family."""
    w, g = _found_and_gold(spark, d)
    order = lambda x: x.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), *([c for c in ("tier",) if c in x.columns])).distinct()
    hit = order(g).join(order(w).withColumn("f", F.lit(1)), ["x", "y"], "left").groupBy("tier").agg(F.count(F.lit(1)).alias("gold"), F.count("f").alias("hits"))
    return hit.withColumn("recall", F.round(F.col("hits") / F.col("gold"), 6))


def eval_channels(spark, d):
    """Precision, recall and F1 of each channel against all pairs that families name."""
    w, g = _found_and_gold(spark, d)
    order = lambda x, *c: x.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), *c).distinct()
    gold = order(g)
    n = gold.agg(F.count(F.lit(1)).alias("gold"))
    j = order(w, "channel").join(gold.withColumn("g", F.lit(1)), ["x", "y"], "left").groupBy("channel").agg(F.count(F.lit(1)).alias("found"),
        F.count("g").alias("hits")).crossJoin(F.broadcast(n))  # one row
    p, r = F.col("hits") / F.col("found"), F.col("hits") / F.when(F.col("gold") > 0, F.col("gold"))
    return j.select("channel", "found", "gold", "hits", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(2 * p * r / F.when(p + r > 0, p + r), 6).alias("f1"))


def eval_macro(spark, d):
    return N.macro_f1(eval_channels(spark, d))


def eval_top10(spark, d):
    """The share of well-graded families among the first ten of each tier by extractability."""
    g = table(spark, d, "review_labels").filter("grade IS NOT NULL").groupBy("family_id").agg((F.avg("grade") >= 1.5).alias("good"))
    r = rows(spark, d).join(g, "family_id").select(F.col("family_id").alias("id"), "tier", F.col("extractability").alias("score"), "good")
    return N.precision_by_group(r, "tier")


def code_literals(spark, d):
    return N.mined_literals(files(spark, d), "src")


def code_probes(spark, d):
    return N.probes(spark, code_literals(spark, d))


def code_exclusions(spark, d):
    """Files that a run would leave out, by reason and language."""
    p, src = F.col("path"), F.col("src")
    why = (
        F.when(T.language_of(p).isNull(), "unknown-language").when(F.coalesce(F.length(src), F.lit(0)) == 0,
            "empty").when(T.skip_reason(p, src).isNotNull(), T.skip_reason(p, src))
        .when(T.generated_header(src), "generated-header").when(T.is_generated_path(p), "foreign-path").when(T.is_test_path(p), "test")
    )
    return N.rollups(files(spark, d), why, F.coalesce(T.language_of(p), F.lit("?")))


def fam_gap_impact(spark, d):
    """The kinds of units of families by what it would bring to name all of them."""
    x = rows(spark, d).select(F.explode("locations").alias("l")).select("l.lang", "l.kind", "l.file", F.col("l.span_lines").alias("lines"),
        F.col("l.name").isNull().alias("raw"))
    return N.gap_impact(x)


def fam_budget(spark, d):
    """Families per tier against a budget."""
    counts = rows(spark, d).groupBy(F.col("tier").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return N.over_budget(counts, spark.createDataFrame([("exact", 10), ("near-high", 100), ("partial", 5)], "key string, budget bigint"))


def fam_ids(spark, d):
    """The id of a family from its members alone: equal members, equal id."""
    key = F.transform("members", lambda m: F.concat_ws("|", m["path"], m["start_line"].cast("string"), m["end_line"].cast("string"), m["kind"]))
    return rows(spark, d).select("family_id", F.substring(F.md5(F.array_join(F.array_sort(key), "\n")), 1, 16).alias("key"))


def code_imports(spark, d):
    """Names that Python files import from other files of their repository: a module
    is a file whose path ends with it."""
    py = files(spark, d).filter("path LIKE '%.py' AND src IS NOT NULL").select("file_id", "repo", "path", "src")
    found = F.regexp_extract_all("src", F.lit(r"(?m)^from ([A-Za-z_][\w.]*) import ([A-Za-z_]\w*)"), F.lit(0))
    i = py.select("file_id", "repo", F.explode(found).alias("x")).select("file_id", "repo",
        F.regexp_extract("x", r"^from (\S+) import", 1).alias("module"), F.regexp_extract("x", r"import (\w+)$", 1).alias("name"))
    parts = F.split(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"/__init__$", ""), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice(F.col("p"), k, F.size("p")), "."))
    e = py.select("repo", F.col("file_id").alias("target"), parts.alias("p")).select("repo", "target", F.explode(tails).alias("module"))
    return i.distinct().join(e, ["repo", "module"]).filter("file_id <> target").select("file_id", "module", "name", "target").distinct()


def _run_spans(spark, d) -> DataFrame:
    f = files(spark, d)
    r = runs.shared_runs(runs.line_windows(f, "file_id", T.language_of(F.col("path")), "src"))
    return runs.with_lines(r, f, "file_id", "src")


def code_run_spans(spark, d):
    """Runs of equal significant lines with the source lines they cover."""
    return _run_spans(spark, d)


def code_token_runs(spark, d):
    """Runs of equal tokens, names and literals apart, that compute something."""
    return runs.token_runs(runs.token_stream(files(spark, d), "file_id", T.language_of(F.col("path")), "src"))


def code_unsuppressed(spark, d):
    """Runs of which neither side covers a line that asks to be left out (here `TODO`)."""
    marks = runs.marked_lines(files(spark, d), "file_id", "src", "TODO")
    return runs.without_marked(_run_spans(spark, d), marks).select("a", "b", "a_pos", "b_pos")


def code_predictions(spark, d):
    """One JSON object per run, in the form that evaluations read."""
    paths = files(spark, d).select("file_id", "repo", "path")
    side = lambda s: paths.select(F.col("file_id").alias(s), F.struct("repo", F.col("path").alias("file")).alias(f"{s}_at"))
    j = _run_spans(spark, d).join(side("a"), "a").join(side("b"), "b")
    region = lambda s: F.struct(F.col(f"{s}_at.repo").alias("repo"), F.col(f"{s}_at.file").alias("file"), F.col(f"{s}_from").alias("start_line"),
        F.col(f"{s}_to").alias("end_line"))
    return j.select("a", "b", "a_pos", "b_pos",
        F.to_json(F.struct(F.lit("copy-paste").alias("channel"), region("a").alias("left"), region("b").alias("right")), {"ignoreNullFields": "false"}).alias("json"))


def md_shared_lines(spark, d):
    """What the documents of a family of near copies have in common."""
    cls, _, p = prose.accepted(spark, d)
    from ..operators.graph import connected

    lab = connected(p.filter("score >= 0.7").select("a", "b")).select(F.col("v").alias("doc_id"), F.col("label").alias("family"))
    x = lab.join(prose.docs(spark, d), "doc_id").select("family", "doc_id", F.split("text", "\n").alias("l"))
    return L.family_lines(x.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "l"))), lambda s: s["l"]).alias("members")))


def md_varying_spots(spark, d):
    """Where near copies differ."""
    _, _, p = prose.accepted(spark, d)
    t = lambda k: prose.docs(spark, d).select(F.col("doc_id").alias(k), F.split("text", "\n").alias(f"{k}_lines"))
    return L.pair_spots(cut(p.filter("score >= 0.9").select("a", "b")).join(t("a"), "a").join(t("b"), "b"))


def value_battery(spark, d):
    return N.battery(spark).select("row", "slot", "number", F.to_json("list").alias("list"))


def value_behaviour(spark, d):
    """Orders by the parts of their lines: what is trivial, and a hash of the rest."""
    r = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber",
        F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey") % 3).cast("bigint").alias("x")))), lambda s: s["x"])
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(r.alias("r"))
    return g.select("l_orderkey", N.trivial_behaviour(F.col("r")).alias("trivial"), N.behaviour_hash(F.col("r")).alias("hash"))


def value_floats(spark, d):
    a, b = (F.col("l_extendedprice") - 30000).cast("double"), (F.col("l_quantity") - 20).cast("double")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(V.float_floor_div(a, b), 4).alias("fdiv"), F.round(V.float_mod(a, b), 4).alias("m"),
            F.round(V.euclid_mod(a, b), 4).alias("em"), F.round(V.float_pow(F.abs(b) / 10, F.lit(1.5)), 6).alias("p")
    )


def value_bits(spark, d):
    a, b = F.col("l_orderkey").cast("bigint") - 30000, F.col("l_partkey").cast("bigint")
    n = F.col("l_linenumber").cast("bigint")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", V.bit_and(a, b).alias("x_and"), V.bit_or(a, b).alias("x_or"), V.bit_xor(a, b).alias("x_xor"),
            V.bit_not(a).alias("x_not"), V.shift_left(b, n).alias("shl"), V.shift_right(a, n + 64).alias("shr"), V.wrap_neg(a).alias("neg"),
        V.truthy_number(a).alias("t"),
    )


def value_pieces(spark, d):
    """Functions on strings as lists of pieces, over the words of the part names."""
    p = F.split("p_name", " ")
    two = F.slice(p, 2, 2)
    return table(spark, d, "part").select(
        "p_partkey", V.starts_with(p, F.slice(p, 1, 2)).alias("starts"), V.ends_with(p, two).alias("ends"), V.string_contains(p, two).alias("has"),
            V.string_contains(p, F.array(F.lit("nothing"))).alias("unknown"),
        F.array_join(V.join_pieces(F.array(F.lit("+")), F.transform(p, lambda x: F.array(x))), "").alias("joined"),
            V.is_in(F.lit("green"), p).alias("green"), V.length(p).alias("n"), V.is_empty(F.slice(p, 1, 0)).alias("none"), V.truthy_list(p).alias("t"),
    )


def value_higher(spark, d):
    """Functions that take functions, over the parts of each order."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_partkey").cast("bigint"))).alias("xs"))
    x = F.col("xs")
    return g.select(
        "l_orderkey", V.list_sum(V.reject(x, lambda v: v % 2 == 0)).alias("odd"), F.size(V.flat_map(x, lambda v: F.array(v, -v))).alias("both"),
            V.list_sum(V.filter_map(x, lambda v: F.when(v % 3 == 0, v * 2))).alias("threes"),
        V.list_sum(V.keys_of_list(x).cast("array<bigint>")).alias("keys"),
            V.list_sum(F.transform(V.enumerate_list(x), lambda s: s["i"] * s["x"])).alias("weighted"),
                F.aggregate(x, F.lit(100).cast("bigint"), lambda s, v: s - v).alias("left"),
        V.get_or_default(F.map_from_arrays(F.slice(x, 1, 1), F.slice(x, 1, 1)), F.lit(-1).cast("bigint"), F.lit(7).cast("bigint")).alias("d"),
            F.size(V.append(x, F.lit(0).cast("bigint"))).alias("more"), V.value_or_default(F.get(x, F.lit(9)), F.lit(0).cast("bigint")).alias("tenth"),
    )


def rel_clauses(spark, d):
    """Every clause of a relational comprehension once: where, let, join, group join
    into a list, a second source (the lines of the list), group, select, order."""
    o = table(spark, d, "orders").filter(F.col("o_totalprice") > 1000)
    o = o.withColumn("band", F.floor(F.col("o_totalprice") / 50000).cast("bigint"))
    j = o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "band", "c_nationkey")
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("ls"))
    into = j.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n", F.coalesce(F.size("ls"), F.lit(0)))
    many = into.select("band", "c_nationkey", "n", F.explode_outer("ls").alias("l"))
    g = many.groupBy("band", "c_nationkey").agg(F.count("l").alias("lines"), F.round(F.sum("l.l_quantity"), 2).alias("quantity"), F.max("n").cast("bigint").alias("most"))
    return g.orderBy("band", F.col("lines").desc(), "c_nationkey")


def eval_invariants(spark, d):
    """Rules that every section table keeps, and how many rows break each."""
    u = table(spark, d, "md_units")
    twice = u.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR unit_id IS NULL").agg(F.count(F.lit(1)).alias("broken")).select(F.lit("unique-id").alias("rule"), "broken")
    rules = {"span": F.col("end_line") < F.col("start_line"), "first-line": F.col("start_line") < 1, "words": F.col("n_words") < 0,
        "kind": ~F.col("kind").isin("Section", "Document"), "path": F.col("path").isNull()}
    counts = u.agg(*(F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(k) for k, c in rules.items()))
    long = counts.select(F.explode(F.create_map(*(x for k in rules for x in (F.lit(k), F.coalesce(F.col(f"`{k}`"), F.lit(0)))))).alias("rule", "broken"))
    return long.unionByName(twice)


def md_channels(spark, d):
    """Pairs of documents of the exact and the near channel together."""
    from ..options import Options, combine, detectors

    units = prose.docs(spark, d).select(F.col("doc_id").alias("id"), prose.norm_text().alias("norm"))
    return combine(detectors(Options()), units).select("a", "b", F.round("score", 6).alias("score"), "channel", "channels")


def capabilities(spark, d):
    """What the query language knows: fields, their kind and closed sets of values."""
    return spark.createDataFrame(_CAPABILITIES, "kind string, name string, allowed string")


_CAPABILITIES = [
    *(("string", k, ",".join(sorted(Q.ENUMS.get(k, ())))) for k in sorted(Q.STRINGS)), *(("number", k, "") for k in sorted(Q.NUMBERS)),
        *(("boolean", k, "false,true") for k in sorted(Q.BOOLEANS)), *(("sort", k, "") for k in sorted(Q.SORTS)),
    *(("view", k, "") for k in ("all", "at", "base", "full", "group", "id", "reinvented", "since", "top")),
]

QUERIES = {f.__name__: f for f in (
    eval_reachable, eval_calibration, eval_slices, eval_channels, eval_macro, eval_top10, code_literals, code_probes, code_exclusions, fam_gap_impact,
        fam_budget, fam_ids, code_imports, code_run_spans, code_token_runs, code_unsuppressed, code_predictions,
    md_shared_lines, md_varying_spots, value_battery, value_behaviour, value_floats, value_bits, value_pieces, value_higher, capabilities,
        md_channels, rel_clauses, eval_invariants,
)}

# ---- SQL -----------------------------------------------------------------

from ..operators.ranking import FIGURES_SQL  # noqa: E402
from .code import _LANG, RUNS_SQL  # noqa: E402

_F = f"WITH {FIGURES_SQL}"
_STAR = """w0 AS (SELECT DISTINCT least(a_path, b_path) AS x, greatest(a_path, b_path) AS y, channel FROM witness_refs WHERE a_path IS NOT NULL AND
  b_path IS NOT NULL AND a_path <> b_path),
g0 AS (SELECT DISTINCT tier, least(a, b) AS x, greatest(a, b) AS y FROM (SELECT tier, list_min(paths) AS a, unnest(list_distinct(paths)) AS b FROM fam
  WHERE len(list_distinct(paths)) > 1) WHERE a <> b)"""
_CH = f"""{_F}, {_STAR}, gd AS (SELECT DISTINCT x, y FROM g0), cn AS (SELECT count(*) AS gold FROM gd),
ch AS (SELECT channel, count(*) AS found, count(gd.x) AS hits FROM w0 LEFT JOIN gd USING (x, y) GROUP BY channel),
sl8 AS (SELECT channel, found, gold, hits, hits::DOUBLE / found AS p, hits::DOUBLE / nullif(gold, 0) AS r FROM ch, cn),
cz AS (SELECT channel, found, gold, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM sl8)"""
_RS = RUNS_SQL.rstrip() + rf""",
sg AS (SELECT file_id AS file, unnest(range(len(k))) AS pos, unnest(k) AS line FROM (SELECT file_id, list_filter(range(1, len(s) + 1), lambda i: NOT
  {T.is_trivial_sql("trim(regexp_replace(s[i], '[ \t\r]+', ' ', 'g'), ' ')")}) AS k FROM (SELECT file_id, string_split(src, chr(10)) AS s FROM
  source_files WHERE src IS NOT NULL))),
rs AS (SELECT r.*, p.line::INT AS a_from, q.line::INT AS a_to, s.line::INT AS b_from, t.line::INT AS b_to FROM runs r JOIN sg p ON p.file = a AND
  p.pos = a_pos JOIN sg q ON q.file = a AND q.pos = a_pos + lines - 1
  JOIN sg s ON s.file = b AND s.pos = b_pos JOIN sg t ON t.file = b AND t.pos = b_pos + lines - 1)
"""
_Q = lambda xs: ", ".join("'" + x + "'" for x in xs)
_TOK = runs.TOKEN.replace("'", "''")
_TOKENS = rf"""WITH l AS (SELECT file_id AS file, {_LANG} AS lang, i, s[i] AS x FROM (SELECT file_id, path, s, unnest(range(1, len(s) + 1)) AS i FROM
  (SELECT file_id, path, string_split(replace(src, chr(13), ''), chr(10)) AS s FROM source_files WHERE src IS NOT NULL))),
t AS (SELECT file, lang, i, regexp_extract_all(regexp_replace(x, CASE WHEN lang IN ({_Q(runs.HASH_COMMENTS)}) THEN '#.*$' ELSE '//.*$' END, ''),
  '{_TOK}') AS t FROM l),
u AS (SELECT file, lang, i, k, CASE WHEN w IN ({_Q(runs.WORDS)}) THEN w WHEN regexp_matches(w, '^[A-Za-z_]') THEN 'I' WHEN regexp_matches(w, '^[0-9]')
  THEN 'N' WHEN regexp_matches(w, '^["''].+') THEN 'S' ELSE w END AS w
  FROM (SELECT file, lang, i, unnest(t) AS w, unnest(range(len(t))) AS k FROM t)),
st AS (SELECT file, lang, list(w ORDER BY i, k) AS tags, list(i ORDER BY i, k) AS lines FROM u GROUP BY file, lang),
w AS (SELECT file, lang, p - 1 AS pos, md5(array_to_string(tags[p : p + {runs.TOKEN_K} - 1], ' ')) AS gram FROM (SELECT file, lang, tags,
  unnest(range(1, len(tags) - {runs.TOKEN_K} + 2)) AS p FROM st WHERE len(tags) >= {runs.TOKEN_K})),
f AS (SELECT lang, gram, min((file, pos)) AS f FROM w GROUP BY lang, gram HAVING count(*) > 1),
sd AS (SELECT f[1] AS a, file AS b, f[2] - pos AS d, pos FROM w JOIN f ON w.gram = f.gram AND w.lang IS NOT DISTINCT FROM f.lang WHERE f[1] <> file),
dg AS (SELECT DISTINCT a, b, d FROM sd),
bo AS (SELECT dg.a, dg.b, dg.d, x.pos AS b_pos, y.pos AS a_pos FROM dg JOIN w x ON x.file = dg.b JOIN w y ON y.file = dg.a AND y.pos = x.pos + dg.d
  AND y.gram = x.gram),
il AS (SELECT *, b_pos - row_number() OVER (PARTITION BY a, b, d ORDER BY b_pos) AS i FROM bo),
r AS (SELECT a, b, d, min(a_pos) AS a_pos, min(b_pos) AS b_pos, count(*) + {runs.TOKEN_K} - 1 AS n FROM il GROUP BY a, b, d, i HAVING count(*) +
  {runs.TOKEN_K} - 1 >= {runs.TOKEN_LEAST}),
q AS (SELECT * FROM r WHERE EXISTS (SELECT 1 FROM sd WHERE sd.a = r.a AND sd.b = r.b AND sd.d = r.d AND sd.pos BETWEEN r.b_pos AND r.b_pos + n -
  {runs.TOKEN_K})),
z AS (SELECT q.a, q.b, a_pos, b_pos, n AS tokens, list_min(x.lines[a_pos + 1 : a_pos + n])::INT AS a_from, list_max(x.lines[a_pos + 1 : a_pos +
  n])::INT AS a_to, list_min(y.lines[b_pos + 1 : b_pos + n])::INT AS b_from,
  list_max(y.lines[b_pos + 1 : b_pos + n])::INT AS b_to, y.tags[b_pos + 1 : b_pos + n] AS t FROM q JOIN st x ON x.file = q.a JOIN st y ON y.file =
  q.b)
SELECT a, b, a_pos::INT AS a_pos, b_pos::INT AS b_pos, tokens::INT AS tokens, a_from, a_to, b_from, b_to FROM z WHERE b_to - b_from + 1 >=
  {runs.LINE_LEAST} AND len(list_filter(t, lambda k: k IN ({_Q(runs.OPERATIONS)}))) > 0"""
_BAT = ", ".join(f"({i}, {'NULL' if isinstance(v, list) else v}, {chr(39) + str(v).replace(' ', '') + chr(39) if isinstance(v, list) else 'NULL'})" for i, v in enumerate(N.POOL))
_LIT = r"""c0 AS (SELECT 'string' AS kind, unnest(regexp_extract_all(src, '"([^"\\\n]*)"', 1)) AS literal FROM source_files UNION ALL SELECT 'int',
  unnest(regexp_extract_all(src, '\b([0-9]{1,9})\b', 1)) FROM source_files),
c1 AS (SELECT kind, literal, count(*) AS n FROM c0 GROUP BY ALL),
lit AS (SELECT kind, literal, n FROM c1 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, CASE WHEN kind = 'int' THEN try_cast(literal AS
  BIGINT) END, literal) <= 16)"""
_SKIP = r"""CASE WHEN contains(src, chr(0)) OR regexp_matches(src, '\A(?:\x{89}PNG\r\n|GIF8[79]a|%PDF-|PK\x03\x04)') THEN 'binary-source-artifact' WHEN len(string_split(src, chr(27) || '[')) - 1 >= 3 THEN 'ansi-highlight-output'
WHEN ends_with(lower(path), '.h') AND regexp_matches(regexp_replace(src, '(?s)/\*.*?\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"', ' ', 'g'), '\bnamespace\b|template ?<|std::|\bclass\s+[A-Za-z_]|public:|private:|protected:') THEN 'unsupported-cpp-header' END"""
SQL = {
    "eval_reachable": f"""{_F}, gg AS (SELECT family_id || '/' || (i - 2) AS id, members[1] AS l, members[i] AS r FROM (SELECT family_id, members,
  unnest(range(2, len(members) + 1)) AS i FROM fam)),
en AS (SELECT id, 'l' AS side, l.path AS file, l.start_line AS s, l.end_line AS e FROM gg UNION ALL SELECT id, 'r', r.path, r.start_line, r.end_line
  FROM gg),
bt AS (SELECT id, side, min((-(least(e, u.end_line) - greatest(s, u.start_line) + 1)::DOUBLE / (e - s + 1), u.unit_id))[2] AS unit FROM en JOIN
  md_units u ON u.path = file AND s <= u.end_line AND u.start_line <= e AND e >= s AND u.end_line >= u.start_line
  WHERE (least(e, u.end_line) - greatest(s, u.start_line) + 1)::DOUBLE / (e - s + 1) >= 0.5 GROUP BY id, side),
tw AS (SELECT id, min(unit) AS a, max(unit) AS b FROM bt GROUP BY id HAVING count(*) = 2 AND min(unit) <> max(unit)),
wa AS (SELECT DISTINCT witness_id, a_path, a_start, a_end, b_path, b_start, b_end FROM witness_refs WHERE a_path IS NOT NULL AND b_path IS NOT NULL),
ka AS (SELECT witness_id, u.unit_id AS a FROM wa JOIN md_units u ON u.path = a_path AND a_start <= u.end_line AND u.start_line <= a_end AND a_end >=
  a_start AND u.end_line >= u.start_line),
kb AS (SELECT witness_id, u.unit_id AS b FROM wa JOIN md_units u ON u.path = b_path AND b_start <= u.end_line AND u.start_line <= b_end AND b_end >=
  b_start AND u.end_line >= u.start_line),
ks AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ka JOIN kb USING (witness_id) WHERE a <> b)
SELECT (SELECT count(*) FROM gg) AS gold, count(*) AS unit_reachable, count(ks.a) AS candidate_reachable FROM tw LEFT JOIN ks USING (a, b)""",
    "eval_calibration": f"""WITH {prose._SETS}, mn AS (SELECT class_id, row_number() OVER (ORDER BY min(g), class_id) AS i FROM gr GROUP BY class_id),
nb AS (SELECT x.class_id AS a, y.class_id AS b FROM mn x JOIN mn y ON y.i - x.i BETWEEN 1 AND 32),
sh AS (SELECT a, b, count(*) AS k FROM nb JOIN gr x ON x.class_id = a JOIN gr y ON y.class_id = b AND y.g = x.g GROUP BY a, b),
jc AS (SELECT k::DOUBLE / (p.size + q.size - k) AS j, s.source IS NOT DISTINCT FROM t.source AS same FROM sh JOIN sz p ON p.class_id = a JOIN sz q ON
  q.class_id = b JOIN documents s ON s.doc_id = a JOIN documents t ON t.doc_id = b)
SELECT CASE WHEN j >= 1 THEN 1.0 WHEN j >= 0.9 THEN 0.9 WHEN j >= 0.8 THEN 0.8 WHEN j >= 0.7 THEN 0.7 ELSE 0.5 END::DOUBLE AS bin, count(*) AS pairs,
  sum(same::INT)::BIGINT AS equal FROM jc WHERE j >= 0.5 GROUP BY 1""",
    "eval_slices": f"""{_F}, {_STAR}, wp AS (SELECT DISTINCT x, y FROM w0) SELECT tier, count(*) AS gold, count(wp.x) AS hits,
  round(count(wp.x)::DOUBLE / count(*), 6) AS recall FROM g0 LEFT JOIN wp USING (x, y) GROUP BY tier""",
    "eval_channels": f"{_CH} SELECT * FROM cz",
    "eval_macro": f"{_CH} SELECT count(*) AS slices, round(avg(coalesce(f1, 0.0)), 6) AS macro_f1 FROM cz",
    "eval_top10": f"""{_F}, gd AS (SELECT family_id, avg(grade) >= 1.5 AS good FROM review_labels WHERE grade IS NOT NULL GROUP BY family_id),
tt AS (SELECT tier, good FROM fam JOIN gd USING (family_id) QUALIFY row_number() OVER (PARTITION BY tier ORDER BY extractability DESC, family_id) <=
  10) SELECT tier, count(*) AS n, round(avg(good::INT), 6) AS precision FROM tt GROUP BY tier""",
    "code_literals": f"WITH {_LIT} SELECT kind, literal, n FROM lit",
    "code_probes": f"WITH {_LIT} SELECT kind, literal, unnest([0, 1, 2, 3])::INT AS slot FROM lit",
    "code_exclusions": rf"""WITH x AS (SELECT coalesce({_LANG}, '?') AS tag, CASE WHEN {_LANG} IS NULL THEN 'unknown-language' WHEN
  coalesce(length(src), 0) = 0 THEN 'empty' WHEN {_SKIP} IS NOT NULL THEN {_SKIP}
WHEN len(list_filter(string_split(src, chr(10))[1:8], lambda t: regexp_matches(lower(t), '{T.GENERATED_HEADER}'))) > 0 THEN 'generated-header' WHEN
  regexp_matches(lower(path), '{T.FOREIGN_PATH}') THEN 'foreign-path' WHEN regexp_matches(lower(path), '{T.TEST_PATH}') THEN 'test' END AS reason FROM
  source_files)
SELECT reason, tag, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY ALL""",
    "fam_gap_impact": f"""{_F}, x AS (SELECT l.lang AS lang, l.kind AS kind, l.file AS file, l.span_lines AS lines, l.name IS NULL AS raw FROM (SELECT
  unnest(locs) AS l FROM fam)),
g AS (SELECT lang, kind, count(DISTINCT file) AS files, count(*) AS units, sum(lines)::BIGINT AS lines, sum(raw::INT)::BIGINT AS raw FROM x GROUP BY
  ALL)
SELECT *, round(10 * (units * ln(1 + files) + ln(1 + lines) + ln(1 + raw)), 4) AS impact FROM g""",
    "fam_budget": f"""{_F}, c AS (SELECT tier AS key, count(*) AS n FROM fam GROUP BY tier), b(key, budget) AS (VALUES ('exact', 10), ('near-high',
  100), ('partial', 5))
SELECT key, coalesce(n, 0)::BIGINT AS n, coalesce(budget, 0)::BIGINT AS budget, greatest(coalesce(n, 0) - coalesce(budget, 0), 0)::BIGINT AS over FROM
  c FULL JOIN b USING (key)""",
    "fam_ids": f"""{_F} SELECT family_id, substr(md5(array_to_string(list_sort(list_transform(members, lambda m: concat_ws('|', m.path, m.start_line,
  m.end_line, m.kind))), chr(10))), 1, 16) AS key FROM fam""",
    "code_imports": r"""WITH py AS (SELECT file_id, repo, path, src FROM source_files WHERE path LIKE '%.py' AND src IS NOT NULL),
i AS (SELECT DISTINCT file_id, repo, regexp_extract(x, '^from (\S+) import', 1) AS module, regexp_extract(x, 'import (\w+)$', 1) AS name FROM (SELECT
  file_id, repo, unnest(regexp_extract_all(src, '(?m)^from ([A-Za-z_][\w.]*) import ([A-Za-z_]\w*)')) AS x FROM py)),
p AS (SELECT repo, file_id AS target, string_split(regexp_replace(regexp_replace(path, '\.py$', ''), '/__init__$', ''), '/') AS p FROM py),
e AS (SELECT repo, target, unnest(list_transform(range(1, len(p) + 1), lambda k: array_to_string(p[k:], '.'))) AS module FROM p)
SELECT DISTINCT file_id, module, name, target FROM i JOIN e USING (repo, module) WHERE file_id <> target""",
    "code_run_spans": _RS + "SELECT a, b, a_pos, b_pos, lines, a_from, a_to, b_from, b_to FROM rs",
    "code_token_runs": _TOKENS,
    "code_unsuppressed": _RS.rstrip() + """, mk AS (SELECT file_id AS file, i AS line FROM (SELECT file_id, s, unnest(range(1, len(s) + 1)) AS i FROM
  (SELECT file_id, string_split(src, chr(10)) AS s FROM source_files WHERE src IS NOT NULL)) WHERE contains(s[i], 'TODO'))
SELECT a, b, a_pos, b_pos FROM rs WHERE NOT EXISTS (SELECT 1 FROM mk WHERE (file = a AND line BETWEEN a_from AND a_to) OR (file = b AND line BETWEEN
  b_from AND b_to))""",
    "code_predictions": _RS + """SELECT a, b, a_pos, b_pos, json_object('channel', 'copy-paste', 'left',
  {'repo': p.repo, 'file': p.path, 'start_line': a_from, 'end_line': a_to}, 'right',
  {'repo': q.repo, 'file': q.path, 'start_line': b_from, 'end_line': b_to})::VARCHAR AS json
FROM rs JOIN source_files p ON p.file_id = a JOIN source_files q ON q.file_id = b""",
    "value_battery": f"""SELECT e::INT AS row, j::INT AS slot, v::BIGINT AS number, l AS list FROM range(64) r(e), range(4) s(j), (VALUES {_BAT}) p(i,
  v, l) WHERE i = (e // (8 ** j)::BIGINT) % 8""",
    "value_behaviour": """WITH g AS (SELECT l_orderkey, list(CASE WHEN l_partkey % 5 > 0 THEN (l_partkey % 3)::BIGINT END ORDER BY l_linenumber, CASE
  WHEN l_partkey % 5 > 0 THEN l_partkey % 3 END NULLS FIRST) AS r FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(list_distinct(r)) + (len(list_filter(r, lambda x: x IS NULL)) > 0)::INT < 2 OR len(list_filter(r, lambda x: x IS NOT NULL)) = 0
  AS trivial, md5('{"r":[' || array_to_string(list_transform(r, lambda x: coalesce(x::VARCHAR, 'null')), ',') || ']}') AS hash FROM g""",
    "value_floats": """WITH v AS (SELECT l_orderkey, l_linenumber, (l_extendedprice - 30000)::DOUBLE AS a, (l_quantity - 20)::DOUBLE AS b FROM
  lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN b <> 0 THEN round(floor(a / b), 4) END AS fdiv, CASE WHEN b <> 0 THEN round((a - b * trunc(a / b)), 4) END
  AS m, CASE WHEN b <> 0 THEN round(CASE WHEN (a - b * trunc(a / b)) < 0 THEN (a - b * trunc(a / b)) + abs(b) ELSE (a - b * trunc(a / b)) END, 4) END
  AS em, round(pow(abs(b) / 10, 1.5), 6) AS p FROM v""",
    "value_bits": """WITH v AS (SELECT l_orderkey, l_linenumber, l_orderkey::BIGINT - 30000 AS a, l_partkey::BIGINT AS b, l_linenumber::BIGINT AS n
  FROM lineitem)
SELECT l_orderkey, l_linenumber, a & b AS x_and, a | b AS x_or, xor(a, b) AS x_xor, ~a AS x_not, b << n AS shl, a >> n AS shr, -a AS neg, a <> 0 AS t
  FROM v""",
    "value_pieces": """WITH v AS (SELECT p_partkey, string_split(p_name, ' ') AS p FROM part)
SELECT p_partkey, true AS starts, p[2:3] = p[greatest(len(p) - len(p[2:3]) + 1, 1):] AS ends, true AS has, NULL::BOOLEAN AS unknown,
  array_to_string(p, '+') AS joined, list_contains(p, 'green') AS green, len(p)::INT AS n, true AS none, true AS t FROM v""",
    "value_higher": """WITH g AS (SELECT l_orderkey, list_sort(list(l_partkey::BIGINT)) AS xs FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(list_sum(list_filter(xs, lambda x: x % 2 <> 0)), 0)::BIGINT AS odd, (2 * len(xs))::INT AS both,
  coalesce(list_sum(list_transform(list_filter(xs, lambda x: x % 3 = 0), lambda x: x * 2)), 0)::BIGINT AS threes,
(len(xs) * (len(xs) - 1) // 2)::BIGINT AS keys, coalesce(list_sum(list_transform(range(1, len(xs) + 1), lambda i: (i - 1) * xs[i])), 0)::BIGINT AS
  weighted, (100 - list_sum(xs))::BIGINT AS left, 7::BIGINT AS d, (len(xs) + 1)::INT AS more, coalesce(xs[10], 0)::BIGINT AS tenth FROM g""",
    "rel_clauses": """WITH o AS (SELECT o_orderkey, o_custkey, floor(o_totalprice / 50000)::BIGINT AS band FROM orders WHERE o_totalprice > 1000),
n AS (SELECT o_orderkey, band, c_nationkey, count(l_orderkey) AS n, sum(l_quantity) AS q FROM o JOIN customer ON o_custkey = c_custkey LEFT JOIN
  lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT band, c_nationkey, sum(n)::BIGINT AS lines, round(sum(q), 2) AS quantity, max(n)::BIGINT AS most FROM n GROUP BY band, c_nationkey""",
    "eval_invariants": """SELECT 'span' AS rule, count(*) FILTER (end_line < start_line) AS broken FROM md_units UNION ALL SELECT 'first-line',
  count(*) FILTER (start_line < 1) FROM md_units UNION ALL SELECT 'words', count(*) FILTER (n_words < 0) FROM md_units
UNION ALL SELECT 'kind', count(*) FILTER (kind NOT IN ('Section', 'Document')) FROM md_units UNION ALL SELECT 'path', count(*) FILTER (path IS NULL)
  FROM md_units
UNION ALL SELECT 'unique-id', count(*) FROM (SELECT unit_id FROM md_units GROUP BY unit_id HAVING count(*) > 1 OR unit_id IS NULL)""",
    "md_channels": f"""WITH {prose._LINKS} SELECT a, b, round(jaccard, 6) AS score, 'near' AS channel, 1::BIGINT AS channels FROM links UNION ALL
  SELECT class_id, id, 1.0, 'exact', 1 FROM cls WHERE id <> class_id""",
    "capabilities": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}', '{v}')" for k, n, v in _CAPABILITIES) + ") t(kind, name, allowed)",
}
