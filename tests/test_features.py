"""Features of Python units and the channels on them."""

from twinfold.operators import anchors
from twinfold.operators import features as X

HELPER = "def mix(a, b):\n    return (a[0] * b + a[1] * b + a[2] * b) / (a[3] + a[4] + b)\n"
WRITTEN_OUT = "def work(xs, k):\n    out = []\n    for x in xs:\n        out.append((x[0] * k + x[1] * k + x[2] * k) / (x[3] + x[4] + k))\n    return out\n"
CALLS = HELPER + WRITTEN_OUT.replace("work", "other").replace("out.append(", "mix(x, k); out.append(")


def features(spark, *texts):
    return X.python_features(spark.createDataFrame([(i, f"p/{i}.py", t) for i, t in enumerate(texts)], "file_id long, path string, src string"))


def test_units_and_values():
    src = "class A:\n    def f(self):\n        if x:\n            for y in z:\n                g(y)\n        return 'a'\nasync def h():\n    await q\n"
    got = [(u[0], u[1], u[2], u[3]) for u in X.units_of(src)]
    assert got == [("Class", "A", 1, 6), ("Method", "f", 2, 6), ("Block", None, 3, 5), ("Block", None, 4, 5), ("Function", "h", 7, 8)]
    assert X.units_of("def broken(") == [] and X.units_of("") == []
    a, b = (X.units_of(s)[0] for s in (HELPER, HELPER.replace("a", "p").replace("b", "q")))
    assert a[6] == b[6] and a[9] == b[9] and a[14] and not X.units_of("def f(x):\n    g(x)\n    return x\n")[0][14] and not X.units_of(src)[4][15]


def test_rare_anchor_and_helper(spark):
    u = features(spark, HELPER, WRITTEN_OUT, CALLS, None, "def broken(").cache()
    ids = {(r.file_id, r.name): r.unit_id for r in u.collect() if r.name}
    got = {(r.container, r.helper) for r in anchors.reinvented(X.with_called_returns(u)).collect()}
    assert (ids[1, "work"], ids[0, "mix"]) in got  # written out in full
    assert not any(c == ids[2, "other"] for c, _ in got)  # it calls the helper of its own file
    pairs = {(r.a, r.b) for r in anchors.rare_anchor_pairs(u).collect()}
    assert (ids[0, "mix"], ids[1, "work"]) in pairs


def test_slim_units(spark):
    """What the helpers need is the same without the heavy columns."""
    names = X.python_features(spark.createDataFrame([(0, "a.py", "")], "file_id long, path string, src string")).columns
    src = CALLS + "class A:\n    def f(self):\n        while a:\n            return [1, b.c]\n        yield\n"
    whole = [dict(zip(names[3:], u)) for u in X.units_of(src)]
    assert [list(u) for u in X.units_of(src, slim=True)] == [[v for k, v in u.items() if k not in X.HEAVY] for u in whole]


def test_equal_helpers_do_not_multiply(spark):
    """Many helpers that return the same are one entry of a value; the first one that
    is smaller than the container counts, as over all pairs."""
    long = HELPER.replace("    return", "    c = a\n    return")
    texts = [*[long] * 12, *[HELPER] * 12, WRITTEN_OUT, long.replace("mix", "blend")]
    u = X.with_called_returns(X.python_features(spark.createDataFrame([(i, f"p/{99 - i}.py", t) for i, t in enumerate(texts)], "file_id long, path string, src string"), slim=True)).cache()
    (r,) = anchors.helpers(u).collect()
    assert len(r.h) == 2
    rows = u.collect()
    fit = [x for x in rows if x.pure_single_return and len(x.returns) == 1 and len(x.value) >= 8]
    want = {}
    for c in rows:
        for h in fit:
            if c.token_count > h.token_count and not c.called_helper_returns and h.returns[0] in [x.hash for x in c.anchors]:
                want[c.unit_id] = min(want.get(c.unit_id, ("~",)), (h.path, h.start_line, h.unit_id))
    got = {x.container: x.helper for x in anchors.reinvented(u).collect()}
    assert got == {k: v[2] for k, v in want.items()} and len(got) > 12


def test_channels(spark):
    twice = WRITTEN_OUT.replace("xs", "rows").replace("out", "res")
    u = features(spark, WRITTEN_OUT, twice, "x = 1\n").cache()
    ids = {(r.file_id, r.name): r.unit_id for r in u.collect() if r.name}
    got = {(r.a, r.b): r for r in X.scored_pairs(u).collect()}
    same = got[ids[0, "work"], ids[1, "work"]]
    assert (same.exact, same.score) == (1.0, 1.0) and same.strict > 0.9
    assert all(a // X.PLACES != b // X.PLACES for a, b in got)  # the loop inside a function is no copy of it


def test_one_literal_varies(spark):
    a = "def f(x):\n    y = x + 1\n    return [y, 'a', 3]\n"
    u = features(spark, a, a.replace("3", "4"), a.replace("3", "'z'"))
    from pyspark.sql import functions as F

    got = anchors.abstraction(u.select(F.col("shape").alias("family_id"), F.lit("python").alias("lang"), "kind", "literals")).collect()
    assert [(r.pos, r.parametric) for r in got] == [(2, True)]
