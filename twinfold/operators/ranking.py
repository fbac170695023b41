"""Families as one row each with the figures that rank them, and what is built on
that: facets, scopes, value, extractability, hazard, surface, shape and hint.

Sites of a family are its members; what kind of code they hold, in which language
and under which name, comes from its locations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scale import cut

_LINES = "transform(members, m -> greatest(m.end_line - m.start_line + 1, 0))"
#: Mean size of the value graph below which a family of classes is a type definition.
TYPE_SEM = 12.0
#: A family of at most so many mean lines is trivial; one with so many varying spots a shared line is shallow.
TRIVIAL_LINES, SHALLOW = 4, 0.33
#: Weight of a family in the default order by the surface it is shown on.
SURFACE_WEIGHT = {"default": 1.0, "divergence": 0.35, "shallow": 0.05, "hidden": 0.05, "debug": 0.02}
#: Varying spots from which an extraction is not clean any more.
HIGH_PARAMS = 6


def effective_copies(members: Column) -> Column:
    """Copies beyond the first; six count in full, more by the square root of what
    they are above six."""
    n = F.greatest(members - 1, F.lit(0)).cast("double")
    return F.when(n <= 6, n).otherwise(6 + F.sqrt(n - 6))


def spread(files: Column, modules: Column, langs: Column) -> Column:
    above = lambda c, most=None: F.greatest((F.least(c, F.lit(most)) if most else c) - 1, F.lit(0))
    return 1 + 0.3 * above(files, 8) + 0.5 * above(modules, 6) + 0.5 * above(langs)


def discount(all_class: Column, mean_sem: Column, all_generated: Column) -> Column:
    """What a reviewer reliably dismisses: type definitions, and files of others."""
    return F.when(all_class & (mean_sem < TYPE_SEM), 0.25).otherwise(1.0) * F.when(all_generated, 0.1).otherwise(1.0)


def line_weight(df: Column, n_files: Column) -> Column:
    """1 for a line that at most a quarter of the files hold, 0 from six tenths on."""
    return F.when(n_files <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.60 - df / n_files) / 0.35)))


def reason(witness: Column, mean_lines: Column, shared: Column, params: Column) -> Column:
    """Why a family is no clean candidate, null if it is one. A proven one always is."""
    return (
        F.when(witness.isin("exact", "subdag"), None)
        .when(mean_lines <= TRIVIAL_LINES, "trivial")
        .when((shared > 0) & (params >= SHALLOW * shared), "shallow-extraction")
    )


def surface(
    why: Column, members: Column, files: Column, modules: Column, mean_lines: Column, all_generated: Column, all_test: Column,
    sites: Column, fragments: Column, all_enclosed: Column, effects: Column, guards: Column,
) -> Column:
    """Where a family is shown. `fragments` of its `sites` are parts of units;
    effects and guards tell whether any of them has an effect or only leaves."""
    tiny = all_test & all_enclosed & ((mean_lines <= 3) | (effects & (mean_lines <= 4)))
    base = (
        F.when(all_generated | (mean_lines <= 1) | ((fragments > 0) & (members >= 8) & (mean_lines <= 3)), "hidden")
        .when(fragments < F.greatest(sites, F.lit(1)), "default")
        .when(tiny, "hidden")
        .when((members >= 8) & (mean_lines <= 3), "hidden")
        .when(effects & ~all_test & (mean_lines >= 12) & (files >= 2) & (modules >= 2), "default")
        .when(effects & (mean_lines <= 3) & all_enclosed, "hidden")
        .when(effects, "divergence")
        .when(guards & (mean_lines >= 12) & (files >= 2) & ~all_test, "default")
        .when(guards & (mean_lines <= 3), "hidden")
        .when(guards, "divergence")
        .when(mean_lines <= 8, "divergence")
        .otherwise("default")
    )
    return F.when(base != "default", base).when(why == "trivial", "hidden").when(why == "shallow-extraction", "shallow").otherwise(base)


def shape(locations: Column, scope: Column, langs: Column, mean_sem: Column) -> Column:
    """What would be done about a family, by the kinds of its units; without
    locations a helper would be extracted."""
    named = F.filter(locations, lambda x: x["kind"].isin("Function", "Method") & x["name"].isNotNull())
    inline = F.size(F.filter(locations, lambda x: x["kind"] == "Block"))
    helper = F.get(named, F.lit(0))
    callable_ = (scope == "test") | ~F.coalesce(T.is_test_site(helper["file"], helper["name"]), F.lit(False))
    every = lambda kind: F.forall(locations, lambda x: F.coalesce(x["kind"] == kind, F.lit(False)))
    return (
        F.when(F.coalesce(F.size(locations), F.lit(0)) <= 0, "extract-helper")
        .when((F.size(named) == 1) & callable_ & (inline >= 1) & (inline == F.size(locations) - 1), "call-existing-helper")
        .when(langs > 1, "consolidate-cross-language")
        .when(every("Class") & (mean_sem < TYPE_SEM), "consolidate-type")
        .when(every("Class"), "extract-base-class")
        .when(every("Block"), "extract-method-from-block")
        .otherwise("extract-helper")
    )


def hint(shape_: Column, locations: Column, members: Column, modules: Column, langs: Column, params: Column, scope: Column) -> Column:
    """One sentence on what to do, from facts of the family only."""
    text = lambda c: c.cast("string")
    named = F.filter(locations, lambda x: x["kind"].isin("Function", "Method") & x["name"].isNotNull())
    helper = F.get(named, F.lit(0))
    inline = F.size(locations) - 1
    call = F.concat(
        F.when(inline == 1, F.lit("1 site reimplements `")).otherwise(F.concat(text(inline), F.lit(" sites reimplement `"))), helper["name"],
            F.lit("` — call the existing helper ("), helper["file"], F.lit(")")
    )
    many = (params >= HIGH_PARAMS) & (langs <= 1)
    careful = F.concat(F.lit(" — high-parameter ("), text(params), F.lit(" varying spots): verify the copies really match the helper before swapping in calls"))
    names = F.transform(locations, lambda x: x["name"])
    same = (F.size(names) > 0) & (F.size(names) == members) & F.forall(names, lambda n: n.eqNullSafe(F.get(names, F.lit(0)))) & F.get(names, F.lit(0)).isNotNull()
    cross = F.when(langs > 1, F.lit(" (cross-language)")).otherwise(F.lit(""))
    every = lambda kind: (F.size(locations) > 0) & F.forall(locations, lambda x: F.coalesce(x["kind"] == kind, F.lit(False)))
    act = (
        F.when(shape_ == "consolidate-type", "consolidate into one shared type")
        .when(every("Class"), "extract a shared base class / mixin")
        .when(every("Block"), "extract a method from the repeated block")
        .otherwise("extract a helper")
    )
    base = (
        F.when(same, F.concat(F.lit("consolidate `"), F.get(names, F.lit(0)), F.lit("` — "), text(members), F.lit(" copies"), cross))
        .when((modules >= 3) & every("Class"), F.concat(F.lit("repeated across "), text(modules), F.lit(" directories — "), act, cross))
        .when(modules >= 3, F.concat(F.lit("repeated across "), text(modules), F.lit(" directories — extract a shared abstraction"), cross))
        .when(modules >= 2, F.concat(F.lit("duplicated across "), text(modules), F.lit(" directories — "), act, cross))
        .otherwise(F.concat(F.lit("local duplication — "), act, cross))
    )
    price = F.concat(base, F.lit(" — high-parameter ("), text(params),
        F.lit(" varying spots): divergence readability; a smaller helper for the invariant core may fit better"))
    scaffold = F.concat(base, F.lit(" — test scaffolding: consolidate only a genuinely shared fixture/helper, not per-scenario setup"))
    return F.when(shape_ == "call-existing-helper", F.when(many, F.concat(call, careful)).otherwise(call)).when(many, price).when(scope == "test",
        scaffold).otherwise(base)


def shared_weights(shared_lines: DataFrame, line_idf: DataFrame | None) -> DataFrame:
    """(family_id, shared_lines, params, shared_weight): the number of rank lines,
    let through as far as two of them that are not trivial are rare in the
    collection. Lines the collection does not know count as held by one file."""
    one = shared_lines.filter("family_id IS NOT NULL").groupBy("family_id").agg(F.max("display").alias("shared_lines"),
        F.max("params").alias("params"), F.max("rank_lines").alias("rank_lines"))
    if line_idf is None:
        return one.select("family_id", "shared_lines", "params", F.coalesce(F.col("shared_lines"), F.lit(0)).cast("double").alias("shared_weight"))
    scans = line_idf.filter("scan_id IS NOT NULL").groupBy("scan_id", "line").agg(F.max("df").alias("df"), F.max("n_files").alias("n"))
    total = scans.groupBy("scan_id").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))
    known = scans.filter("line IS NOT NULL").groupBy("line").agg(F.sum("df").alias("df"))
    lines = one.select("family_id", F.explode("rank_lines").alias("line")).filter("line IS NOT NULL").filter(~T.is_trivial_line(F.col("line")))
    weighed = lines.join(known, "line", "left").crossJoin(F.broadcast(total))  # one row
    gate = weighed.groupBy("family_id").agg(F.least(F.lit(1.0), F.sum(line_weight(F.coalesce("df", F.lit(1)), F.col("n_files"))) / 2).alias("gate"))
    size = F.size(F.filter("rank_lines", lambda x: x.isNotNull()))
    return one.join(gate, "family_id", "left").select("family_id", "shared_lines", "params",
        (F.greatest(size, F.lit(0)) * F.coalesce("gate", F.lit(0.0))).alias("shared_weight"))


def family_rows(families: DataFrame, shared_lines: DataFrame | None = None, line_idf: DataFrame | None = None) -> DataFrame:
    """One row per family_id. Rows delivered again are the same; of differing rows
    the one loaded last counts."""
    newest = F.max_by(F.struct(*[c for c in families.columns if c != "family_id"]), F.struct("loaded_at", "reported_at"))
    one = families.filter("family_id IS NOT NULL").groupBy("family_id").agg(newest.alias("r")).select("family_id", "r.*")
    paths = F.expr("filter(transform(members, m -> m.path), p -> p IS NOT NULL)")
    locs = F.expr("filter(coalesce(locations, array()), l -> l IS NOT NULL)")
    mods = F.array_distinct(F.transform(paths, T.module_of))
    langs = F.array_distinct(F.filter(F.transform(locs, lambda x: x["lang"]), lambda x: x.isNotNull()))
    tests = F.size(F.filter(paths, T.is_test_path))
    lines = F.expr(_LINES)
    names = F.transform(locs, lambda x: x["name"])
    sems = F.expr("filter(transform(coalesce(locations, array()), l -> l.sem), x -> x IS NOT NULL)")
    total = F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + x)
    widest = F.get(F.array_sort(F.expr("transform(members, (m, i) -> struct(-(m.end_line - m.start_line) AS o, i AS i, m.path AS path))")), F.lit(0))["path"]
    out = one.select(
        "family_id", "tier", F.when(F.isnan("score"), None).otherwise(F.col("score")).alias("score"), "removable", "is_exact", "is_template",
            "reported_at", "members", locs.alias("locations"),
        F.greatest(F.size("members"), F.lit(0)).cast("bigint").alias("n_members"), F.size(F.array_distinct(paths)).alias("n_files"),
            F.size(mods).alias("n_modules"), F.size(langs).alias("n_langs"),
        langs.alias("langs"), F.when(tests == 0, "prod").when(tests == F.size(paths), "test").otherwise("mixed").alias("scope"),
        F.when(F.size("members") > 0, F.floor(total / F.size("members"))).otherwise(F.lit(0)).cast("bigint").alias("mean_lines"), lines.alias("lines"),
        F.when(F.size(sems) > 0, F.aggregate(sems, F.lit(0.0), lambda a, x: a + x) / F.size(sems)).alias("mean_sem"),
        ((F.size(names) > 1) & F.get(names, F.lit(0)).isNotNull() & F.forall(names, lambda n: n.eqNullSafe(F.get(names, F.lit(0))))).alias("same_symbol"),
        widest.alias("file"), F.coalesce(F.nullif(T.module_of(widest), F.lit("")), F.lit(".")).alias("dir"),
            F.get(F.transform(locs, lambda x: x["lang"]), F.lit(0)).alias("first_lang"),
        ((F.size(locs) > 0) & F.forall(locs, lambda x: F.coalesce(x["kind"] == "Class", F.lit(False)))).alias("all_class"),
        ((F.size(paths) > 0) & F.forall(paths, T.is_generated_path)).alias("all_generated"),
        F.when(F.col("is_exact"), "exact").when(F.col("tier").startswith("near"), "similar").when(F.col("tier") == "partial",
            "subdag").otherwise("copy-paste").alias("witness"),
    )
    if shared_lines is not None:
        out = out.join(shared_weights(shared_lines, line_idf), "family_id", "left")
    else:
        out = out.select("*", F.lit(None).cast("int").alias("shared_lines"), F.lit(None).cast("int").alias("params"), F.lit(None).cast("double").alias("shared_weight"))
    n, mean_lines = F.col("n_members"), F.col("mean_lines")
    weight, params, sem = F.coalesce("shared_weight", F.lit(0.0)), F.coalesce("params", F.lit(0)), F.coalesce("mean_sem", F.lit(0.0))
    eff, spr, score = effective_copies(n), spread(F.col("n_files"), F.col("n_modules"), F.col("n_langs")), F.coalesce("score", F.lit(0.0))
    off = discount(F.col("all_class"), sem, F.col("all_generated"))
    why = reason(F.col("witness"), mean_lines, F.coalesce("shared_lines", F.lit(0)), params)
    none, no = F.lit(0), F.lit(False)
    shown = surface(why, n, F.col("n_files"), F.col("n_modules"), mean_lines, F.col("all_generated"), F.col("scope") == "test", n, none, no, no, no)
    out = out.select("*", (mean_lines * F.greatest(n - 1, F.lit(0))).alias("dup_lines"),
        F.round(mean_lines * eff * score * spr * off, 4).alias("value"), why.alias("reason"), shown.alias("surface"),
            shape(F.col("locations"), F.col("scope"), F.col("n_langs"), sem).alias("shape"))
    mean = F.when(F.size("lines") > 0, F.aggregate("lines", F.lit(0.0), lambda a, x: a + x) / F.size("lines")).otherwise(0.0)
    var = F.when(F.size("lines") > 0, F.aggregate("lines", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size("lines")).otherwise(0.0)
    many = F.col("n_langs") > 1
    homog = F.when(~many & (F.size("lines") >= 2) & (mean > 0), 1 / (1 + F.sqrt(var) / mean)).otherwise(1.0)
    rep = F.greatest(F.coalesce(F.array_max("lines"), mean_lines), F.lit(1)).cast("double")
    size = F.when(many, mean_lines * score).otherwise(weight)
    tight = F.when(many, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean_lines - 3) / 6))).otherwise(F.least(weight / rep, F.lit(1.0)))
    on = F.coalesce(*(F.when(F.col("surface") == k, v) for k, v in SURFACE_WEIGHT.items()), F.lit(1.0))
    out = out.withColumn("extractability", F.round(size * tight * homog * eff * spr / (1 + 0.5 * params) * off * on, 4))
    seen = F.when(many, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight / F.greatest(mean_lines, F.lit(1)))))
    cost = F.when(F.col("scope") == "test", 0.25).when(F.col("scope") == "mixed", 0.5).otherwise(1.0)
    out = out.withColumn("hazard", F.round(mean_lines * spr * (0.3 + 0.7 * (1 - seen)) * cost, 4))
    removes = F.when(many, F.col("dup_lines")).otherwise(F.greatest(n - 1, F.lit(0)) * F.coalesce("shared_lines", F.lit(0)))
    return out.select("*", removes.cast("bigint").alias("removable_lines"),
        hint(F.col("shape"), F.col("locations"), n, F.col("n_modules"), F.col("n_langs"), params, F.col("scope")).alias("hint"))


def facet(rows: DataFrame, field: Column, order: list[Column]) -> DataFrame:
    """(key, families, removable, exemplar): groups with their count, the removable
    lines and the family that stands first in `order`."""
    g = rows.withColumn("key", F.coalesce(field.cast("string"), F.lit("?")))
    return g.groupBy("key").agg(F.count(F.lit(1)).alias("families"), F.sum(F.coalesce("removable", F.lit(0))).alias("removable"),
        F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col("family_id"))).alias("m")).select("key", "families", "removable",
            F.col("m.family_id").alias("exemplar"))


def folded(rows: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(family_id, primary): families that are slices of one that ranks higher. The
    families of `rows` that `overlaps` (a, b) links, directly or through others, are
    one opportunity; its primary is the first by extractability, value and id."""
    from .graph import connected

    asked = rows.select("family_id", "extractability", "value")
    within = overlaps.join(asked.select(F.col("family_id").alias("a")), "a", "left_semi").join(asked.select(F.col("family_id").alias("b")), "b",
        "left_semi").select("a", "b")
    part = connected(within).select(F.col("v").alias("family_id"), "label").join(asked, "family_id")
    part = cut(part)
    first = part.groupBy("label").agg(F.min(F.struct((-F.col("extractability")).alias("x"), (-F.col("value")).alias("y"),
        "family_id")).alias("m")).select("label", F.col("m.family_id").alias("primary"))
    return part.join(first, "label").filter("family_id <> primary").select("family_id", "primary")


# ---- SQL -----------------------------------------------------------------

_EVERY = "len(locs) > 0 AND len(list_filter(locs, lambda l: l.kind = '{}')) = len(locs)"
FIGURES_SQL = rf"""
fr AS (SELECT * FROM families WHERE family_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY loaded_at DESC NULLS LAST,
  reported_at DESC NULLS LAST) = 1),
fp AS (SELECT * EXCLUDE (locations), list_filter(coalesce(locations, []), lambda l: l IS NOT NULL) AS locs, list_filter(list_transform(members, lambda
  m: m.path), lambda p: p IS NOT NULL) AS paths,
         list_transform(members, lambda m: greatest(m.end_line - m.start_line + 1, 0)) AS lines FROM fr),
fq AS (SELECT *, list_distinct(list_filter(list_transform(locs, lambda l: l.lang), lambda x: x IS NOT NULL)) AS langs, list_transform(locs, lambda l:
  l.name) AS names,
         list_filter(list_transform(locs, lambda l: l.sem), lambda x: x IS NOT NULL) AS sems, len(list_filter(paths, lambda p:
  regexp_matches(lower(p), '{T.TEST_PATH}'))) AS tests,
         len(paths) > 0 AND len(list_filter(paths, lambda p: regexp_matches(lower(p), '{T.FOREIGN_PATH}'))) = len(paths) AS all_generated,
         len(members)::BIGINT AS n_members, len(list_distinct(paths))::INT AS n_files, len(list_distinct(list_transform(paths, lambda p:
  regexp_extract(p, '^(.*)/[^/]*$', 1))))::INT AS n_modules FROM fp),
si AS (SELECT scan_id, line, max(df) AS df, max(n_files) AS n FROM line_idf WHERE scan_id IS NOT NULL GROUP BY ALL),
sn AS (SELECT sum(n) AS n FROM (SELECT scan_id, max(n) AS n FROM si GROUP BY scan_id)),
sk AS (SELECT line, sum(df) AS df FROM si WHERE line IS NOT NULL GROUP BY line),
so AS (SELECT family_id, max(display) AS shared_lines, max(params) AS params, max(rank_lines) AS rank_lines FROM shared_lines WHERE family_id IS NOT
  NULL GROUP BY family_id),
sg AS (SELECT family_id, least(1.0, sum(CASE WHEN n <= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, (0.60 - coalesce(df, 1)::DOUBLE / n) / 0.35)) END) /
  2) AS gate
       FROM (SELECT family_id, unnest(rank_lines) AS line FROM so) LEFT JOIN sk USING (line), sn WHERE line IS NOT NULL AND NOT
  {T.is_trivial_sql('line')} GROUP BY family_id),
sl AS (SELECT family_id, shared_lines, params, coalesce(len(list_filter(rank_lines, lambda x: x IS NOT NULL)), 0) * coalesce(gate, 0.0) AS
  shared_weight FROM so LEFT JOIN sg USING (family_id)),
fg AS (SELECT q.*, s.shared_lines, s.params, s.shared_weight, coalesce(s.shared_weight, 0.0) AS sw, len(langs)::INT AS n_langs, CASE WHEN len(sems) >
  0 THEN list_sum(sems)::DOUBLE / len(sems) END AS mean_sem,
         CASE WHEN score IS NULL OR isnan(score) THEN 0.0 ELSE score END AS sc, CASE WHEN tests = 0 THEN 'prod' WHEN tests = len(paths) THEN 'test'
  ELSE 'mixed' END AS scope,
         CASE WHEN n_members > 0 THEN (list_sum(lines) // n_members)::BIGINT ELSE 0 END AS mean_lines,
         CASE WHEN is_exact THEN 'exact' WHEN starts_with(tier, 'near') THEN 'similar' WHEN tier = 'partial' THEN 'subdag' ELSE 'copy-paste' END AS
  witness,
         {_EVERY.format('Class')} AS all_class, {_EVERY.format('Block')} AS all_block,
         list_filter(locs, lambda l: l.kind IN ('Function', 'Method') AND l.name IS NOT NULL) AS named, len(list_filter(locs, lambda l: l.kind =
  'Block')) AS inline,
         len(names) > 1 AND names[1] IS NOT NULL AND len(list_filter(names, lambda n: n = names[1])) = len(names) AS same_symbol,
         CASE WHEN len(lines) > 0 THEN list_sum(lines)::DOUBLE / len(lines) ELSE 0 END AS ml FROM fq q LEFT JOIN sl s USING (family_id)),
fh AS (SELECT *, 1 + 0.3 * greatest(least(n_files, 8) - 1, 0) + 0.5 * greatest(least(n_modules, 6) - 1, 0) + 0.5 * greatest(n_langs - 1, 0) AS spr,
  mean_lines * greatest(n_members - 1, 0) AS dup_lines,
         CASE WHEN n_members <= 7 THEN greatest(n_members - 1, 0)::DOUBLE ELSE 6 + sqrt(n_members - 7) END AS eff,
         CASE WHEN all_class AND coalesce(mean_sem, 0) < 12 THEN 0.25 ELSE 1.0 END * CASE WHEN all_generated THEN 0.1 ELSE 1.0 END AS disc,
         CASE WHEN len(lines) > 0 THEN list_sum(list_transform(lines, lambda x: (x - ml) * (x - ml)))::DOUBLE / len(lines) ELSE 0 END AS var,
         CASE WHEN witness IN ('exact', 'subdag') THEN NULL WHEN mean_lines <= 4 THEN 'trivial' WHEN coalesce(shared_lines, 0) > 0 AND
  coalesce(params, 0) >= 0.33 * shared_lines THEN 'shallow-extraction' END AS reason,
         CASE WHEN len(locs) = 0 THEN 'extract-helper' WHEN len(named) = 1 AND inline >= 1 AND inline = len(locs) - 1 AND (scope = 'test' OR NOT
  coalesce(regexp_matches(lower(named[1].file), '{T.TEST_PATH}') OR starts_with(named[1].name, 'Test') OR starts_with(named[1].name, 'test_'), false))
  THEN 'call-existing-helper'
              WHEN n_langs > 1 THEN 'consolidate-cross-language' WHEN all_class AND coalesce(mean_sem, 0) < 12 THEN 'consolidate-type' WHEN all_class
  THEN 'extract-base-class' WHEN all_block THEN 'extract-method-from-block' ELSE 'extract-helper' END AS shape FROM fg),
fi AS (SELECT *, CASE WHEN all_generated OR mean_lines <= 1 THEN 'hidden' WHEN reason = 'trivial' THEN 'hidden' WHEN reason = 'shallow-extraction'
  THEN 'shallow' ELSE 'default' END AS surface FROM fh),
fam AS (SELECT *, round(mean_lines * eff * sc * spr * disc, 4) AS value,
          round(CASE WHEN n_langs > 1 THEN mean_lines * sc * greatest(0.0, least(1.0, (mean_lines - 3) / 6.0)) ELSE sw * least(1.0, sw /
  greatest(list_max(lines), 1)) * CASE WHEN len(lines) >= 2 AND ml > 0 THEN 1 / (1 + sqrt(var) / ml) ELSE 1.0 END END
                * eff * spr / (1 + 0.5 * coalesce(params, 0)) * disc * CASE surface WHEN 'default' THEN 1.0 ELSE 0.05 END, 4) AS extractability,
          round(mean_lines * spr * (0.3 + 0.7 * (1 - CASE WHEN n_langs > 1 THEN 0.0 ELSE greatest(0.0, least(1.0, sw / greatest(mean_lines, 1))) END))
  * CASE scope WHEN 'test' THEN 0.25 WHEN 'mixed' THEN 0.5 ELSE 1.0 END, 4) AS hazard,
          (CASE WHEN n_langs > 1 THEN dup_lines ELSE greatest(n_members - 1, 0) * coalesce(shared_lines, 0) END)::BIGINT AS removable_lines FROM fi)"""
