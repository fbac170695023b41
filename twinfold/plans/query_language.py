"""The query language over the family table: terms `field op value`, grouping,
sorting, top, look-ups by id and place, and the views built on them.

    scope=prod,mixed  path~docs  members>3  tier!=exact  group=tier  sort=value  top=10  id=4b07  at=a.md:12
    all  full  reinvented  since=<baseline>  base=<change>

Terms are joined by AND; a comma is OR; `=` on a path is a substring test; `!=` is
the inversion of `=`, so a null matches it. Unknown fields, values outside a closed
set and numbers that do not parse are errors; that goes for `>=` and `<=` too,
which the language does not have.

`run` applies terms to the rows it is given. `view` is what a user sees: families of
the default surface (`all` or a term on `surface` widens it) without the slices of
families that rank higher.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import spans, temporal
from ..operators.ranking import facet, folded

STRINGS = {
    "tier": "tier", "witness": "witness", "scope": "scope", "status": "status", "id": "family_id", "surface": "surface", "shape": "shape",
        "extraction_shape": "shape", "dir": "dir", "spotclass": "spotclass",
}
NUMBERS = {
    "members": "n_members", "sites": "n_members", "copies": "n_members", "files": "n_files", "modules": "n_modules", "dirs": "n_modules",
        "langs": "n_langs", "languages": "n_langs", "lines": "mean_lines",
    "mean_lines": "mean_lines", "dup": "dup_lines", "dup_lines": "dup_lines", "removable": "removable", "score": "score", "value": "value",
        "extractability": "extractability", "hazard": "hazard",
    "shared": "shared_lines", "shared_lines": "shared_lines", "params": "params", "sem": "mean_sem",
}
BOOLEANS = {"exact": "is_exact", "template": "is_template", "same_symbol": "same_symbol"}
ENUMS = {
    "scope": {"prod", "test", "mixed"},
    "status": {"new", "changed", "unchanged"},
    "tier": {"exact", "near-high", "near-med", "near-low", "partial"},
    "witness": {"exact", "subdag", "copy-paste", "similar", "shared-core", "copypaste", "structural"},
    "shape": {"call-existing-helper", "extract-helper", "extract-method-from-block", "consolidate-type", "extract-base-class", "consolidate-cross-language"},
    "spotclass": {"leaf-only", "structural"},
}
ENUMS["extraction_shape"] = ENUMS["shape"]
ALIASES = {"shared-core": "subdag", "copypaste": "copy-paste", "structural": "similar"}
#: Keys of groups beyond the fields above, and what stands where a family has none.
GROUPS = {"lang": "first_lang", "language": "first_lang", "file": "file"}
MISSING = {"spotclass": "unwitnessed", "lang": "", "language": "", "file": ""}
SORTS = {"extractability": "extractability", "extract": "extractability", "value": "value", "sites": "n_members", "members": "n_members",
    "copies": "n_members", "hazard": "hazard", "removable": "removable", "score": "score"}
_TERM = re.compile(r"([a-z_]+)(!~|!=|~|>|<|=)(.*)", re.S)


class QueryError(ValueError):
    pass


@dataclass
class Query:
    filters: list[Column] = field(default_factory=list)
    fields: set[str] = field(default_factory=set)
    group: str | None = None
    sort: str = "extractability"
    sorted: bool = False
    top: int = 30
    place: tuple[str, int] | None = None
    id: str | None = None
    all: bool = False
    full: bool = False
    reinvented: bool = False
    since: str | None = None
    base: str | None = None


def _number(s: str, term: str) -> float:
    try:
        return float(s)
    except ValueError:
        raise QueryError(f"{term}: not a number") from None


def _any_path(v: str) -> Column:
    return F.exists("members", lambda m: F.coalesce(m["path"].contains(v), F.lit(False)))


def _any_lang(v: str, part: bool) -> Column:
    return F.exists("langs", (lambda x: x.contains(v)) if part else (lambda x: x == v))


def _term(name: str, op: str, value: str, term: str) -> Column:
    values = value.split(",")
    if name in ("path", "file"):
        if op in "><":
            raise QueryError(f"{term}: not a numeric field")
        hit = reduce(lambda a, b: a | b, [_any_path(v) for v in values])
        return ~hit if op.startswith("!") else hit
    if name in ("lang", "language"):
        if op in "><":
            raise QueryError(f"{term}: not a numeric field")
        hit = reduce(lambda a, b: a | b, [_any_lang(v, op.endswith("~")) for v in values])
        return ~hit if op.startswith("!") else hit
    if name in NUMBERS:
        c = F.col(NUMBERS[name]).cast("double")
        if op == ">":
            return F.coalesce(c > _number(value, term), F.lit(False))
        if op == "<":
            return F.coalesce(c < _number(value, term), F.lit(False))
        if "~" in op:
            raise QueryError(f"{term}: a numeric field has no substring test")
        hit = reduce(lambda a, b: a | b, [F.abs(c - _number(v, term)) < 1e-9 for v in values])
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if op == "!=" else hit
    if name in BOOLEANS:
        if value not in ("true", "false") or op not in ("=", "!="):
            raise QueryError(f"{term}: true or false")
        hit = F.coalesce(F.col(BOOLEANS[name]) == F.lit(value == "true"), F.lit(False))
        return ~hit if op == "!=" else hit
    if name in STRINGS:
        if op in "><":
            raise QueryError(f"{term}: not a numeric field")
        enum = ENUMS.get(name)
        if enum and "~" not in op and not set(values) <= enum:
            raise QueryError(f"{term}: one of {', '.join(sorted(enum))}")
        if name == "witness" and "~" not in op:
            values = [ALIASES.get(v, v) for v in values]
        c = F.col(STRINGS[name])
        hit = reduce(lambda a, b: a | b, [c.contains(v) if "~" in op else (c.startswith(v) if name == "id" else c == v) for v in values])
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if op.startswith("!") else hit
    raise QueryError(f"unknown field {name}")


def parse(terms: list[str]) -> Query:
    q = Query()
    for term in terms:
        if term in ("all", "full", "reinvented"):
            setattr(q, term, True)
            continue
        m = _TERM.fullmatch(term)
        if not m or not m[3]:
            raise QueryError(f"{term}: not a term")
        name, op, value = m.groups()
        if name in ("group", "sort", "top", "at", "since", "base") and op != "=":
            raise QueryError(f"{term}: takes =")
        if name == "group":
            q.group = value
        elif name == "since":
            q.since = value
        elif name == "base":
            q.base = value
        elif name == "sort":
            if value not in SORTS:
                raise QueryError(f"{term}: one of {', '.join(sorted(SORTS))}")
            q.sort, q.sorted = SORTS[value], True
        elif name == "top":
            if not value.isdigit():
                raise QueryError(f"{term}: not a count")
            q.top = int(value)
        elif name == "at":
            path, _, line = value.rpartition(":")
            if not path or not line.isdigit():
                raise QueryError(f"{term}: path:line")
            q.place = (path, int(line))
        else:
            if name == "id" and op == "=":
                q.id = value
            q.fields.add(name)
            q.filters.append(_term(name, op, value, term))
    return q


def ordering(sort: str) -> list[Column]:
    """Descending by the key, then by value, then by id; nulls last."""
    return [F.col(sort).desc_nulls_last(), F.col("value").desc_nulls_last(), F.col("family_id").asc()]


def _with_optional(rows: DataFrame) -> DataFrame:
    """Columns that only some rows have: the class of varying spots."""
    return rows if "spotclass" in rows.columns else rows.withColumn("spotclass", F.lit(None).cast("string"))


def _apply(q: Query, rows: DataFrame) -> DataFrame:
    if ("status" in q.fields or q.group == "status") and "status" not in rows.columns:
        raise QueryError("status needs a snapshot: add since=<baseline>")
    rows = _with_optional(rows)
    for f in q.filters:
        rows = rows.filter(f)
    if q.place:
        path, line = q.place
        rows = rows.filter(F.exists("members", lambda m: m["path"].contains(path) & (m["start_line"] <= line) & (m["end_line"] >= line)))
    if q.group:
        name = {**STRINGS, **NUMBERS, **BOOLEANS, **GROUPS}.get(q.group)
        key = F.col(name).cast("string") if name else F.lit(None).cast("string")
        if q.group in MISSING:
            key = F.coalesce(key, F.lit(MISSING[q.group]))
        out = facet(rows, key, [-F.coalesce(F.col(q.sort), F.lit(0)), -F.col("value")]).orderBy(F.col("removable").desc(), F.col("families").desc(), F.col("key").asc())
    else:
        out = rows.orderBy(*ordering(q.sort))
        if q.place:
            return out.limit(1)
    return out.limit(q.top) if q.top else out


def run(rows: DataFrame, terms: list[str]) -> DataFrame:
    """The families (or groups) of `rows` that `terms` ask for; top=0 gives all."""
    return _apply(parse(terms), rows)


def with_status(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """`rows` with `status` against a baseline of (family_id, place, digest)."""
    s = temporal.status(baseline, temporal.places(rows)).filter("status <> 'resolved'")
    return rows.join(s, "family_id", "left").withColumn("status", F.coalesce("status", F.lit("unchanged")))


def slices(rows: DataFrame) -> DataFrame:
    """(family_id, primary) among the families of the default surface."""
    shown = rows.filter("surface = 'default'")
    return folded(shown, spans.overlapping(shown))


def view(rows: DataFrame, terms: list[str], *, baselines: dict[str, DataFrame] | None = None, changes: dict[str, DataFrame] | None = None,
    reinvented: DataFrame | None = None) -> DataFrame:
    """What a user sees of `rows` for `terms`. `baselines` and `changes` are the
    tables that since= and base= name: (family_id, place, digest) and (file, start,
    end); `reinvented` is the table of that view, with whether either side is a test."""
    q = parse(terms)
    if q.base is not None:
        if q.all or q.full or q.reinvented or q.group or q.place or q.since or q.sorted or q.filters:
            raise QueryError("base= is a view of its own: only top= goes with it")
        if q.base not in (changes or {}):
            raise QueryError(f"base={q.base}: no such change")
        hit = spans.divergence(rows, changes[q.base]).join(rows.select("family_id", "hazard", "value"), "family_id").orderBy(*ordering("hazard"))
        return hit.limit(q.top) if q.top else hit
    if q.reinvented:
        if reinvented is None:
            raise QueryError("reinvented: no findings were given")
        out = reinvented.filter("NOT container_in_test AND NOT helper_in_test")
        return out.limit(q.top) if q.top else out
    if q.since is not None:
        if q.since not in (baselines or {}):
            raise QueryError(f"since={q.since}: no such baseline")
        rows = with_status(rows, baselines[q.since])
    if q.id is None and not q.place:  # a look-up finds every family
        fold = slices(rows)
        if not (q.all or "surface" in q.fields):
            rows = rows.filter("surface = 'default'")
        rows = rows.join(fold.select("family_id"), "family_id", "left_anti")
    out = _apply(q, rows)
    return out if q.full or q.group else out.drop("locations", "lines")


def fails(rows: DataFrame, on: str, baseline: DataFrame | None = None) -> DataFrame:
    """The families a gate counts: with `any` all that are reported, with `new` those
    that are new or changed against the baseline, which it needs."""
    if on not in ("any", "new"):
        raise QueryError(f"fail on {on}: any or new")
    if on == "new":
        if baseline is None:
            raise QueryError("fail on new needs a baseline")
        rows = with_status(rows, baseline).filter("status <> 'unchanged'")
    return rows.filter("surface = 'default'").join(slices(rows).select("family_id"), "family_id", "left_anti")
