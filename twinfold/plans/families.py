"""Registered queries over the family table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking as R
from ..operators import spans as SP
from ..operators import temporal as TM
from ..tables import table
from .query_language import fails, run, slices, view

_SHOW = ["family_id", "tier", "n_members", "n_files", "n_modules", "scope", "mean_lines", "dup_lines", "value", "extractability", "hazard"]


def rows(spark, d: str) -> DataFrame:
    return R.family_rows(table(spark, d, "families"), table(spark, d, "shared_lines"), table(spark, d, "line_idf"))


def fam_figures(spark, d):
    return rows(spark, d).select(*_SHOW, "n_langs", "removable", "removable_lines", F.round("shared_weight", 6).alias("shared_weight"), "reason",
        "surface", "shape", "witness", "same_symbol")


def _filter(terms):
    return lambda spark, d: run(rows(spark, d), [*terms, "top=0"]).select(*_SHOW)


def _group(terms):
    return lambda spark, d: run(rows(spark, d), [*terms, "top=0"])


def fam_top(spark, d):
    return run(rows(spark, d), ["sort=value", "top=25"]).select("family_id", "value")


def fam_at(spark, d):
    """The best family with a member that covers line 60 of some guide."""
    return run(rows(spark, d), ["at=guide.md:60"]).select("family_id", "value")


def fam_dashboard(spark, d):
    """Families, members and removable lines per tier and scope."""
    return rows(spark, d).groupBy("tier", "scope").agg(F.count(F.lit(1)).alias("families"), F.sum("n_members").alias("members"), F.sum("removable").alias("removable"))


def fam_hotspots(spark, d):
    """Folders by the removable lines of the families in them."""
    m = rows(spark, d).select("family_id", "dup_lines", F.explode("members").alias("m")).select("family_id", "dup_lines",
        F.regexp_extract("m.path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()
    return m.groupBy("folder").agg(F.count(F.lit(1)).alias("families"), F.sum("dup_lines").alias("lines"))


def fam_json(spark, d):
    """One JSON object per family, as the JSON sink writes it."""
    place = F.transform("locations", lambda x: F.struct(x["file"].alias("file"), x["start_line"].alias("start"), x["end_line"].alias("end"),
        x["name"].alias("name"), x["lang"].alias("lang")))
    body = F.struct(
        F.col("family_id").alias("id"), "scope", "witness", "surface", F.col("n_members").alias("members"), F.col("n_files").alias("files"),
            F.col("n_modules").alias("dirs"), F.col("n_langs").alias("languages"),
        (F.col("n_langs") == 1).alias("source_comparable"), F.coalesce("shared_lines", F.lit(0)).alias("shared"),
            F.coalesce(F.array_max("lines"), F.lit(0)).alias("rep_lines"), F.coalesce("params", F.lit(0)).alias("params"),
        F.col("removable_lines").alias("removable"), F.col("shape").alias("extraction_shape"), "same_symbol",
            F.col("reason").alias("actionability_reason"), place.alias("locations"),
    )
    return rows(spark, d).select("family_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def fam_hints(spark, d):
    """What the figures of a family suggest, in a sentence."""
    return rows(spark, d).select("family_id", "hint")


def _before(spark, d):
    return TM.snapshots(table(spark, d, "families"), "2024-07-01")[0]


def _change(spark, d):
    return table(spark, d, "witness_refs").filter("channel = 'near'").select(F.col("a_path").alias("file"), F.col("a_start").alias("start"), F.col("a_end").alias("end"))


def fam_slices(spark, d):
    """Families of the default surface that are slices of one that ranks higher."""
    return slices(rows(spark, d))


def fam_view(spark, d):
    """The default view: the default surface, slices folded, by extractability."""
    return view(rows(spark, d), ["top=0"]).select(*_SHOW)


def fam_view_all(spark, d):
    return view(rows(spark, d), ["all", "sort=hazard", "top=0"]).select("family_id", "surface", "hazard")


def fam_view_surface(spark, d):
    return view(rows(spark, d), ["surface=shallow,hidden", "top=0"]).select("family_id", "surface", "reason")


def fam_view_groups(spark, d):
    """Families of the default view by what would be done about them."""
    return view(rows(spark, d), ["group=shape", "top=0"])


def fam_open(spark, d):
    """One family by the beginning of its id, with all its fields."""
    return view(rows(spark, d), ["id=4b07", "full"]).select("family_id", F.size("locations").alias("n_locations"), "surface")


def fam_since(spark, d):
    """Families that are new or changed since a baseline of mid-2024, whatever their surface."""
    return view(rows(spark, d), ["since=early", "status!=unchanged", "all", "top=0"], baselines={"early": _before(spark, d)}).select("family_id", "status")


def fam_base(spark, d):
    """Families that a change touched in part, the most hazardous first."""
    return view(rows(spark, d), ["base=near", "top=0"], changes={"near": _change(spark, d)}).select("family_id", "members", "touched", "hazard")


def fam_gate(spark, d):
    """The families a gate on new and changed ones counts."""
    return fails(rows(spark, d), "new", _before(spark, d)).select("family_id", "status")


def fam_status(spark, d):
    """Families against a baseline of those reported before mid-2024."""
    return TM.status(*TM.snapshots(table(spark, d, "families"), "2024-07-01"))


def fam_status_counts(spark, d):
    return fam_status(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("families"))


def fam_unignored(spark, d):
    """Families left after the ignores: all members under a docs folder, or a given id."""
    entries = [{"paths": ["**/docs/**"], "reason": "generated docs"}, {"family_id": "4b070493e3794a78", "reason": "accepted"},
        {"paths": ["**/wiki/**"], "reason": "old", "expires_at": "2020-01-01"}]
    return TM.without_ignored(rows(spark, d), entries, today="2026-01-01").select("family_id")


def fam_divergence(spark, d):
    """Families of which a change touches some members and leaves others."""
    return SP.divergence(rows(spark, d), _change(spark, d))


def fam_overlaps(spark, d):
    """Pairs of families with at least two members that overlap by half or more."""
    return SP.overlapping(rows(spark, d))


def fam_kept_members(spark, d):
    """Members left when, per file, one that lies half inside a longer one goes."""
    return SP.without_overlaps(rows(spark, d))


def fam_subsumed(spark, d):
    """Families whose members all lie in those of one larger family."""
    return SP.subsumed(rows(spark, d))


def fam_surface(spark, d):
    """Where a family is shown, and why it is no clean candidate."""
    return rows(spark, d).select("family_id", "surface", "reason")


def fam_edges(spark, d):
    """Path pairs that families name, with how many families name them and the best
    score. The members of a family are tied to its smallest path, so a family of n
    gives n - 1 pairs."""
    p = F.array_distinct(F.expr("filter(transform(members, m -> m.path), p -> p IS NOT NULL)"))
    r = rows(spark, d).select("score", p.alias("p")).filter("size(p) > 1").select("score", F.array_min("p").alias("a"), F.explode("p").alias("b")).filter("a <> b")
    return r.groupBy("a", "b").agg(F.count(F.lit(1)).alias("families"), F.max("score").alias("score"))


QUERIES = {f.__name__: f for f in (fam_hints, fam_slices, fam_view, fam_view_all, fam_view_surface, fam_view_groups, fam_open, fam_since, fam_base,
    fam_gate, fam_subsumed, fam_surface, fam_edges, fam_figures, fam_top, fam_at, fam_dashboard, fam_hotspots, fam_json, fam_status,
        fam_status_counts, fam_unignored, fam_divergence, fam_overlaps, fam_kept_members)}
_DIR = "coalesce(nullif(regexp_extract(list_sort(list_transform(range(1, len(members) + 1), lambda i: {'o': members[i].start_line - members[i].end_line, 'i': i, 'p': members[i].path}))[1].p, '^(.*)/[^/]*$', 1), ''), '.')"
_FILTERS = {
    "fam_filter_scope": (["scope=prod,mixed"], "scope IN ('prod', 'mixed')"),
    "fam_filter_path": (["path~wiki"], "len(list_filter(members, lambda m: contains(m.path, 'wiki'))) > 0"),
    "fam_filter_not_lang": (["lang!=python"], "NOT list_contains(langs, 'python')"),
    "fam_filter_numbers": (["members>2", "value>100", "params<4"], "n_members > 2 AND value > 100 AND params < 4"),
    "fam_filter_tier_not": (["tier!=exact", "exact=false"], "coalesce(tier, '') <> 'exact' AND is_exact = false"),
    "fam_filter_witness": (["witness=exact,structural", "same_symbol=false", "dir~docs"],
        f"witness IN ('exact', 'similar') AND NOT same_symbol AND contains({_DIR}, 'docs')"),
    "fam_filter_shape": (["shape=call-existing-helper,extract-helper"], "shape IN ('call-existing-helper', 'extract-helper')"),
    "fam_filter_spotclass": (["spotclass!=structural", "dirs>1"], "n_modules > 1"),
}
_GROUPS = {"fam_group_tier": ("tier", "tier"), "fam_group_scope": ("scope", "scope"), "fam_group_members": ("members", "n_members"),
    "fam_group_unknown": ("nothing", None), "fam_group_shape": ("shape", "shape"), "fam_group_surface": ("surface", "surface"),
        "fam_group_lang": ("lang", "coalesce(locs[1].lang, '')"), "fam_group_dir": ("dir", _DIR)}
QUERIES |= {k: _filter(t) for k, (t, _) in _FILTERS.items()}
QUERIES |= {k: _group([f"group={g}", "sort=value"]) for k, (g, _) in _GROUPS.items()}

_F = f"WITH {R.FIGURES_SQL}"
_COLS = ", ".join(_SHOW)
_MEM = """mem AS (SELECT family_id, i, m.path AS path, m.start_line AS s, m.end_line AS e FROM (SELECT family_id, unnest(members) AS m,
  unnest(range(len(members))) AS i FROM fam))"""
_OV = f"""{_MEM},
p AS (SELECT x.family_id AS a, y.family_id AS b, x.i, y.i AS k FROM mem x JOIN mem y ON x.path = y.path AND x.family_id < y.family_id AND x.e >= x.s
  AND y.e >= y.s AND 2 * (least(x.e, y.e) - greatest(x.s, y.s) + 1) >= least(x.e - x.s, y.e - y.s) + 1),
gr AS (SELECT a, b, list({{'i': [i], 'k': [k]}} ORDER BY i, k) AS m FROM p GROUP BY a, b),
ov AS (SELECT a, b, len(list_reduce(m, lambda s, x: CASE WHEN list_contains(s.i, x.i[1]) OR list_contains(s.k, x.k[1]) THEN s ELSE {{'i':
  list_concat(s.i, x.i), 'k': list_concat(s.k, x.k)}} END).i)::INT AS n FROM gr)"""
_ST = f"""bs AS ({TM._PLACES_SQL.format("reported_at < TIMESTAMP '2024-07-01'")}),
nw AS ({TM._PLACES_SQL.format("true").replace("FROM families", "FROM fam")}),
st AS (SELECT f.family_id, CASE WHEN n IS NULL OR same = n THEN 'unchanged' WHEN same + near > 0 THEN 'changed' ELSE 'new' END AS status FROM fam f
  LEFT JOIN
  (SELECT family_id, count(*) AS n, count(*) FILTER (digest IN (SELECT digest FROM bs)) AS same, count(*) FILTER (place IN (SELECT place FROM bs)) AS
  near FROM nw GROUP BY family_id) x USING (family_id))"""


def _view_sql(more: str = "", shown: str = "") -> str:
    """The slices among the families of the default surface for which `shown` holds."""
    return f"""{_F.replace("WITH", "WITH RECURSIVE", 1)}, {_OV}{more},
def AS (SELECT family_id FROM fam WHERE surface = 'default'{shown}),
lk AS (SELECT a, b FROM ov WHERE n >= 2 AND a IN (SELECT family_id FROM def) AND b IN (SELECT family_id FROM def)),
ed AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
reach(v, r) AS (SELECT a, a FROM ed UNION SELECT ed.b, reach.r FROM reach JOIN ed ON ed.a = reach.v),
lab AS (SELECT v AS family_id, min(r) AS label FROM reach GROUP BY v),
pri AS (SELECT label, arg_min(family_id, (-extractability, -value, family_id)) AS primary_id FROM lab JOIN fam USING (family_id) GROUP BY label),
sli AS (SELECT family_id, primary_id FROM lab JOIN pri USING (label) WHERE family_id <> primary_id)"""


_V = _view_sql()
_DV = f"""ch AS (SELECT DISTINCT a_path AS file, a_start AS s, a_end AS e FROM witness_refs WHERE channel = 'near' AND a_path IS NOT NULL), {_MEM},
hit AS (SELECT DISTINCT family_id, i FROM mem JOIN ch ON ch.file = mem.path AND mem.s <= ch.e AND ch.s <= mem.e),
g AS (SELECT family_id, count(*) AS members, count(hit.i) AS touched FROM mem LEFT JOIN hit USING (family_id, i) GROUP BY family_id)"""
SQL = {
    "fam_figures": f"""{_F} SELECT {_COLS}, n_langs, removable, removable_lines, CASE WHEN shared_weight IS NOT NULL THEN round(shared_weight, 6) END
  AS shared_weight, reason, surface, shape, witness, same_symbol FROM fam""",
    "fam_top": f"{_F} SELECT family_id, value FROM fam ORDER BY value DESC NULLS LAST, family_id LIMIT 25",
    "fam_at": f"""{_F} SELECT family_id, value FROM fam WHERE len(list_filter(members, lambda m: contains(m.path, 'guide.md') AND m.start_line <= 60
  AND m.end_line >= 60)) > 0 ORDER BY extractability DESC NULLS LAST, value DESC NULLS LAST, family_id LIMIT 1""",
    "fam_dashboard": f"""{_F} SELECT tier, scope, count(*) AS families, sum(n_members)::BIGINT AS members, sum(removable)::BIGINT AS removable FROM
  fam GROUP BY ALL""",
    "fam_hotspots": f"""{_F}, x AS (SELECT DISTINCT family_id, dup_lines, regexp_extract(m.path, '^(.*)/[^/]*$', 1) AS folder FROM (SELECT family_id,
  dup_lines, unnest(members) AS m FROM fam)) SELECT folder, count(*) AS families, sum(dup_lines)::BIGINT AS lines FROM x GROUP BY folder""",
    "fam_json": f"""{_F} SELECT family_id, json_object('id', family_id, 'scope', scope, 'witness', witness, 'surface', surface, 'members', n_members,
  'files', n_files, 'dirs', n_modules, 'languages', n_langs,
'source_comparable', n_langs = 1, 'shared', coalesce(shared_lines, 0), 'rep_lines', coalesce(list_max(lines), 0), 'params', coalesce(params, 0),
  'removable', removable_lines, 'extraction_shape', shape, 'same_symbol', same_symbol,
'actionability_reason', reason, 'locations', list_transform(locs, lambda l: {{'file': l.file, 'start': l.start_line, 'end': l.end_line, 'name':
  l.name, 'lang': l.lang}}))::VARCHAR AS json FROM fam""",
    "fam_hints": f"""{_F}, h AS (SELECT *, coalesce(params, 0) AS pr, CASE WHEN n_langs > 1 THEN ' (cross-language)' ELSE '' END AS crs, CASE WHEN
  shape = 'consolidate-type' THEN 'consolidate into one shared type' WHEN all_class THEN 'extract a shared base class / mixin'
  WHEN all_block THEN 'extract a method from the repeated block' ELSE 'extract a helper' END AS act FROM fam),
i AS (SELECT *, CASE WHEN shape = 'call-existing-helper' THEN CASE WHEN len(locs) = 2 THEN '1 site reimplements' ELSE (len(locs) - 1) ||
  ' sites reimplement' END || ' `' || named[1].name || '` — call the existing helper (' || named[1].file || ')'
  WHEN len(names) = n_members AND len(names) > 0 AND names[1] IS NOT NULL AND len(list_filter(names, lambda n: n = names[1])) = len(names) THEN
  'consolidate `' || names[1] || '` — ' || n_members || ' copies' || crs
  WHEN n_modules >= 3 AND all_class THEN 'repeated across ' || n_modules || ' directories — ' || act || crs WHEN n_modules >= 3 THEN
  'repeated across ' || n_modules || ' directories — extract a shared abstraction' || crs
  WHEN n_modules >= 2 THEN 'duplicated across ' || n_modules || ' directories — ' || act || crs ELSE 'local duplication — ' || act || crs END AS base
  FROM h)
SELECT family_id, base || CASE WHEN pr >= 6 AND n_langs <= 1 THEN ' — high-parameter (' || pr || ' varying spots): ' || CASE WHEN shape =
  'call-existing-helper' THEN 'verify the copies really match the helper before swapping in calls'
  ELSE 'divergence readability; a smaller helper for the invariant core may fit better' END WHEN scope = 'test' AND shape <> 'call-existing-helper'
  THEN ' — test scaffolding: consolidate only a genuinely shared fixture/helper, not per-scenario setup' ELSE '' END AS hint FROM i""",
    "fam_slices": f"{_V} SELECT family_id, primary_id AS primary FROM sli",
    "fam_view": f"{_V} SELECT {_COLS} FROM fam WHERE surface = 'default' AND family_id NOT IN (SELECT family_id FROM sli)",
    "fam_view_all": f"{_V} SELECT family_id, surface, hazard FROM fam WHERE family_id NOT IN (SELECT family_id FROM sli)",
    "fam_view_surface": f"""{_V} SELECT family_id, surface, reason FROM fam WHERE surface IN ('shallow', 'hidden') AND family_id NOT IN (SELECT
  family_id FROM sli)""",
    "fam_view_groups": f"""{_V} SELECT shape AS key, count(*) AS families, sum(coalesce(removable, 0))::BIGINT AS removable, arg_min(family_id,
  (-coalesce(extractability, 0), -value, family_id)) AS exemplar FROM fam
WHERE surface = 'default' AND family_id NOT IN (SELECT family_id FROM sli) GROUP BY shape""",
    "fam_open": f"""{_F} SELECT family_id, len(locs)::INT AS n_locations, surface FROM fam WHERE starts_with(family_id, '4b07') ORDER BY
  extractability DESC, value DESC, family_id LIMIT 30""",
    "fam_since": f"{_V}, {_ST} SELECT family_id, status FROM st WHERE status <> 'unchanged' AND family_id NOT IN (SELECT family_id FROM sli)",
    "fam_gate": f"""{_view_sql(f", {_ST}", " AND family_id IN (SELECT family_id FROM st WHERE status <> 'unchanged')")} SELECT family_id, status FROM
  st JOIN fam USING (family_id) WHERE status <> 'unchanged' AND surface = 'default' AND family_id NOT IN (SELECT family_id FROM sli)""",
    "fam_base": f"""{_F}, {_DV} SELECT family_id, members, touched, hazard FROM (SELECT * FROM g WHERE touched > 0 AND touched < members) JOIN (SELECT
  family_id, hazard FROM fam) USING (family_id)""",
    "fam_unignored": f"""{_F} SELECT family_id FROM fam WHERE NOT (len(paths) > 0 AND len(list_filter(paths, lambda p: regexp_full_match(p,
  '(.*/)?docs/.*'))) = len(paths)) AND family_id <> '4b070493e3794a78'""",
    "fam_divergence": f"{_F}, {_DV} SELECT family_id, members, touched FROM g WHERE touched > 0 AND touched < members",
    "fam_status": TM.STATUS_SQL,
    "fam_status_counts": f"SELECT status, count(*) AS families FROM ({TM.STATUS_SQL}) GROUP BY status",
    "fam_overlaps": f"{_F}, {_OV} SELECT a, b, n AS shared_members FROM ov WHERE n >= 2",
    "fam_subsumed": f"""{_F.replace("WITH", "WITH RECURSIVE", 1)}, r AS (SELECT family_id, members, row_number() OVER (ORDER BY
  coalesce(list_sum(lines), 0) DESC, coalesce(value, 0) DESC, list_min(list_transform(members, lambda m: {{'p': m.path, 's': m.start_line, 'e':
  m.end_line}})), family_id) AS o FROM fam),
m AS (SELECT family_id, o, i, m.path AS path, m.start_line AS s, m.end_line AS e FROM (SELECT family_id, o, unnest(members) AS m,
  unnest(range(len(members))) AS i FROM r)),
j AS (SELECT x.o AS f, y.o AS g, count(DISTINCT x.i) AS covered FROM m x JOIN m y ON x.path = y.path AND y.o < x.o AND x.e >= x.s AND y.e >= y.s AND
  x.s <= y.e AND y.s <= x.e AND least(x.e, y.e) - greatest(x.s, y.s) + 1 >= 0.6 * (x.e - x.s + 1) - 1e-9 GROUP BY ALL),
c AS (SELECT f, list(g ORDER BY g) AS gs FROM j JOIN r ON r.o = f WHERE covered = len(members) GROUP BY f),
n AS (SELECT row_number() OVER (ORDER BY f) AS k, f, gs FROM c),
w(k, gone, bys) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT n.k, CASE WHEN len(list_filter(gs, lambda g: NOT list_contains(gone, g))) > 0 THEN list_append(gone, f) ELSE gone END,
         CASE WHEN len(list_filter(gs, lambda g: NOT list_contains(gone, g))) > 0 THEN list_append(bys, list_filter(gs, lambda g: NOT
  list_contains(gone, g))[1]) ELSE bys END FROM w JOIN n ON n.k = w.k + 1),
z AS (SELECT unnest(gone) AS f, unnest(bys) AS g FROM (SELECT * FROM w ORDER BY k DESC LIMIT 1))
SELECT p.family_id, q.family_id AS by FROM z JOIN r p ON p.o = f JOIN r q ON q.o = g""",
    "fam_kept_members": f"""{_F}, x AS (SELECT family_id, len(members) AS n, list_sort(list_transform(members, lambda m: {{'o': m.start_line -
  m.end_line, 'p': m.path, 's': m.start_line, 'e': m.end_line}})) AS l FROM fam),
y AS (SELECT family_id, n, len(list_reduce(list_transform(l, lambda a: [a]), lambda acc, a: CASE WHEN len(list_filter(acc, lambda k: coalesce(k.p =
  a[1].p AND least(k.e, a[1].e) - greatest(k.s, a[1].s) + 1 >= 0.5 * (a[1].e - a[1].s + 1), false))) > 0 THEN acc ELSE list_concat(acc, a) END)) AS
  kept FROM x WHERE n > 0)
SELECT family_id, kept::INT AS kept, (n - kept)::INT AS dropped FROM y UNION ALL SELECT family_id, 0, 0 FROM x WHERE n = 0""",
    "fam_surface": f"{_F} SELECT family_id, surface, reason FROM fam",
    "fam_edges": f"""{_F}, p AS (SELECT CASE WHEN isnan(score) THEN NULL ELSE score END AS score, list_min(paths) AS a, unnest(list_distinct(paths))
  AS b FROM fam WHERE len(list_distinct(paths)) > 1)
SELECT a, b, count(*) AS families, max(score) AS score FROM p WHERE a <> b GROUP BY a, b""",
}
SQL |= {k: f"{_F} SELECT {_COLS} FROM fam WHERE {w}" for k, (_, w) in _FILTERS.items()}
SQL |= {
    k: f"""{_F}, k AS (SELECT *, {f"coalesce({c}::VARCHAR, '?')" if c else "'?'"} AS key FROM fam)
SELECT key, count(*) AS families, sum(coalesce(removable, 0))::BIGINT AS removable, arg_min(family_id, (-coalesce(value, 0), -value, family_id)) AS
  exemplar FROM k GROUP BY key"""
    for k, (_, c) in _GROUPS.items()
}
