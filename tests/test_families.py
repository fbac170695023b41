"""Figures of families worked out by hand, surfaces and shapes, views and gates."""

import datetime

import pytest
from pyspark.sql import functions as F

from twinfold.operators import ranking as R
from twinfold.operators import spans, temporal
from twinfold.plans import query_language as Q

FAMILY = (
    "family_id string, tier string, score double, members array<struct<path:string,start_line:int,end_line:int,kind:string,heading:string>>, files int, removable bigint, commonness double, is_exact boolean, is_template boolean, "
    "locations array<struct<file:string,start_line:int,end_line:int,lang:string,kind:string,name:string,sem:bigint,span_lines:int>>, reported_at timestamp, loaded_at timestamp"
)
DAY = datetime.datetime(2024, 5, 1)


def family(key, spans_, score=0.9, tier="near-high", locations=None, day=DAY):
    members = [(p, a, z, "Section", None) for p, a, z in spans_]
    locs = [(p, a, z, "python", "Function", None, 20, z - a + 1) for p, a, z in spans_] if locations is None else locations
    return (key, tier, score, members, len(members), 10, 0.1, tier == "exact", False, locs, day, day)


def rows(spark, families, shared=(), idf=()):
    f = spark.createDataFrame(families, FAMILY)
    s = spark.createDataFrame(list(shared), "family_id string, rank_lines array<string>, display int, params int")
    i = spark.createDataFrame(list(idf), "scan_id long, repo string, line string, df int, n_files int, scanned_at timestamp")
    return R.family_rows(f, s, i)


def test_figures_of_a_pair(spark):
    lines = [f"x{i} = f({i})" for i in range(8)]
    idf = [(1, "r", "common", 90, 100, DAY)]
    r = rows(spark, [family("a", [("p/a.md", 1, 10), ("q/b.md", 11, 20)])], [("a", lines, 7, 1)] * 2, idf).first()
    # one copy beyond the first; two files and two modules: 1 + 0.3 + 0.5
    assert (r.dup_lines, r.value) == (10, 16.2)
    assert r.shared_weight == 8.0 and r.extractability == round(8 * 0.8 * 1.8 / 1.5, 4) and r.hazard == round(10 * 1.8 * (0.3 + 0.7 * 0.2), 4)
    assert (r.scope, r.surface, r.shape, r.removable_lines) == ("prod", "default", "extract-helper", 7)
    assert r.hint == "duplicated across 2 directories — extract a helper"


def test_copies_are_dampened_and_idioms_weigh_nothing(spark):
    many = [(f"m{i}/a.md", 1, 10) for i in range(20)]
    got = {r.family_id: r for r in rows(spark, [family("a", many, 1.0), family("b", many[:1]), family("c", [], locations=None)], [("a", ["common", "}", None], 3, 0)], [(1, "r", "common", 61, 100, DAY)]).collect()}
    assert got["a"].value == round(10 * (6 + 13**0.5) * (1 + 0.3 * 7 + 0.5 * 5), 4)
    assert got["a"].shared_weight == 0 and got["a"].extractability == 0
    assert got["b"].value == 0 and got["c"].value == 0 and got["c"].mean_lines == 0


def test_discounts_languages_and_scope(spark):
    two = [("p/a.md", 1, 10), ("p/b.md", 1, 10)]
    loc = lambda kind, lang="go", sem=3, name=None, file="p/a.md": (file, 1, 10, lang, kind, name, sem, 10)
    got = {
        r.family_id: r
        for r in rows(
            spark,
            [
                family("types", two, 1.0, locations=[loc("Class"), loc("Class")]),
                family("vendor", [("x/vendor/a.md", 1, 10), ("x/vendor/b.md", 1, 10)], 1.0),
                family("cross", two, 0.5, locations=[loc("Block"), loc("Block", "rust")]),
                family("tests", [("tests/a.md", 1, 10), ("p/test_b.md", 1, 10)], 1.0),
                family("mixed", [("tests/a.md", 1, 10), ("p/b.md", 1, 10)], 1.0),
                family("helper", two, 1.0, locations=[loc("Function", name="clamp"), loc("Block")]),
                family("tiny", [("p/a.md", 1, 3), ("p/b.md", 1, 3)], 1.0),
            ],
        ).collect()
    }
    assert got["types"].value == round(10 * 1.3 * 0.25, 4) and got["types"].shape == "consolidate-type"
    assert got["vendor"].value == round(10 * 1.3 * 0.1, 4) and got["vendor"].surface == "hidden"
    # across languages: the lines times the score, by how far the mean is from three to nine
    assert got["cross"].extractability == round(10 * 0.5 * 1.0 * (1.3 + 0.5), 4) and got["cross"].hazard == round(10 * 1.8, 4) and got["cross"].shape == "consolidate-cross-language"
    assert (got["tests"].scope, got["mixed"].scope) == ("test", "mixed") and got["tests"].hazard == round(10 * 1.8 * 0.25, 4) and got["mixed"].hazard == round(10 * 1.8 * 0.5, 4)
    assert got["helper"].shape == "call-existing-helper" and got["helper"].hint == "1 site reimplements `clamp` — call the existing helper (p/a.md)"
    assert (got["tiny"].reason, got["tiny"].surface) == ("trivial", "hidden")


def test_surface_of_fragments(spark):
    cols = "why string, members int, files int, modules int, lines int, generated boolean, test boolean, sites int, fragments int, enclosed boolean, effects boolean, guards boolean"
    cases = [
        ((None, 9, 3, 3, 3, False, False, 9, 1, False, False, False), "hidden"), ((None, 2, 2, 2, 20, False, False, 3, 1, False, False, False), "default"), ((None, 2, 2, 2, 4, False, True, 2, 2, True, True, False), "hidden"),
        ((None, 2, 2, 2, 12, False, False, 2, 2, False, True, False), "default"), ((None, 2, 2, 2, 8, False, False, 2, 2, False, True, False), "divergence"), ((None, 2, 2, 1, 12, False, False, 2, 2, False, False, True), "default"),
        ((None, 2, 2, 1, 8, False, False, 2, 2, False, False, False), "divergence"), ((None, 2, 2, 1, 9, False, False, 2, 2, False, False, False), "default"), (("shallow-extraction", 2, 2, 1, 9, False, False, 2, 0, False, False, False), "shallow"),
    ]
    d = spark.createDataFrame([c for c, _ in cases], cols)
    got = [r[0] for r in d.select(R.surface(*(F.col(c) for c in ("why", "members", "files", "modules", "lines", "generated", "test", "sites", "fragments", "enclosed", "effects", "guards")))).collect()]
    assert got == [w for _, w in cases]


def test_overlaps_match_one_to_one_and_fold(spark):
    big = family("big", [("p/a.md", 1, 40), ("q/b.md", 1, 40)])
    cut_ = family("cut", [("p/a.md", 2, 30), ("q/b.md", 2, 30)], 0.8)
    one = family("one", [("p/a.md", 3, 20), ("p/a.md", 5, 20), ("z/c.md", 1, 9)], 0.8)  # both lie in one member of big
    r = rows(spark, [big, cut_, one], [("big", [f"l{i}" for i in range(30)], 30, 0), ("cut", [f"l{i}" for i in range(9)], 9, 0), ("one", [f"l{i}" for i in range(9)], 9, 0)])
    assert {(x.a, x.b): x.shared_members for x in spans.overlapping(r, 1).collect()} == {("big", "cut"): 2, ("big", "one"): 1, ("cut", "one"): 1}
    assert [tuple(x) for x in Q.slices(r).collect()] == [("cut", "big")]
    assert {x.family_id for x in Q.view(r, ["top=0"]).collect()} == {"big", "one"}
    assert {x.family_id for x in Q.view(r, ["id=cut"]).collect()} == {"cut"}
    assert "locations" in Q.view(r, ["id=cut", "full"]).columns and "locations" not in Q.view(r, ["id=cut"]).columns
    assert [tuple(x) for x in spans.subsumed(r).collect()] == [("cut", "big")]


def test_a_family_that_only_dropped_ones_cover_is_kept(spark):
    a = family("a", [("p/a.md", 1, 100), ("q/a.md", 1, 100)])
    b = family("b", [("p/a.md", 31, 120), ("q/a.md", 31, 120)])  # 70 of its 90 lines lie in a
    c = family("c", [("p/a.md", 80, 125), ("q/a.md", 80, 125)])  # 41 of 46 lie in b, 21 in a
    assert {tuple(x) for x in spans.subsumed(rows(spark, [a, b, c])).collect()} == {("b", "a")}


def test_views_and_errors(spark):
    old, new = family("old", [("p/a.md", 1, 10), ("q/b.md", 1, 10)]), family("new", [("p/c.md", 1, 10), ("q/d.md", 1, 10)])
    moved = family("moved", [("p/a.md", 1, 10), ("z/e.md", 1, 10)])
    r = rows(spark, [old, new, moved])
    base = temporal.places(spark.createDataFrame([old], FAMILY))
    since = lambda *t: {x.family_id: x.status for x in Q.view(r, ["since=b", "top=0", *t], baselines={"b": base}).collect()}
    assert since() == {"old": "unchanged", "new": "new", "moved": "changed"} and since("status=new") == {"new": "new"} and since("status!=unchanged") == {"new": "new", "moved": "changed"}
    change = spark.createDataFrame([("p/a.md", 3, 3)], "file string, start int, end int")
    assert {x.family_id for x in Q.view(r, ["base=c", "top=0"], changes={"c": change}).collect()} == {"old", "moved"}
    assert {x.family_id for x in Q.fails(r, "new", base).collect()} == {"new", "moved"} and Q.fails(r, "any").count() == 3
    found = spark.createDataFrame([("x", True, False), ("y", False, False)], "container string, container_in_test boolean, helper_in_test boolean")
    assert [x.container for x in Q.view(r, ["reinvented"], reinvented=found).collect()] == ["y"]
    for bad in (["status=new"], ["group=status"], ["since=nope"], ["base=c", "all"], ["base=nope"], ["reinvented"], ["shape=round"], ["witness=eye"], ["spotclass=x"], ["status=resolved"], ["surface>1"]):
        with pytest.raises(Q.QueryError):
            Q.view(r, bad, changes={"c": change})
    with pytest.raises(Q.QueryError):
        Q.fails(r, "new")
