import random

import pytest
from pyspark.sql import functions as F

from twinfold.operators import align, metrics, runs, similarity, spans, temporal
from twinfold.operators import code as C
from twinfold.operators.graph import connected
from twinfold.operators.scale import cut, dense_ids, hot_keys, lookup, prefix_sums
from twinfold.plans import query_language as Q
from twinfold.sources import state


def test_prefix_sums_and_ids(spark):
    rows = [(k, i, i % 3) for k in "ab" for i in range(50)]
    got = {(r.k, r.i): r.cum_v for r in prefix_sums(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"], ["v"]).collect()}
    for k in "ab":
        for i in range(50):
            assert got[k, i] == sum(j % 3 for j in range(i + 1))
    names = spark.createDataFrame([(x,) for x in ["b", "a", "é", "Z", "a"]], "p string")
    assert [r.p for r in dense_ids(names, ["p"]).orderBy("id").collect()] == sorted({"b", "a", "é", "Z"}, key=str.encode)


def test_lookup_splits_hot_keys(spark, monkeypatch):
    import twinfold.operators.scale as S

    monkeypatch.setattr(S, "HOT_ROWS", 10)
    big = spark.range(200).select(F.when(F.col("id") < 150, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    small = spark.createDataFrame([(0, "hot"), (160, "cold")], "k long, v string")
    assert hot_keys(big, "k").count() == 1
    got = lookup(big, small, "k", "left")
    assert got.count() == 200 and got.filter("v = 'hot'").count() == 150 and got.filter("v = 'cold'").count() == 1 and got.columns == ["k", "x", "v"]


def test_connected_against_union_find(spark):
    rnd = random.Random(4)
    e = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in e:
        if a != b:
            p[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.v: r.label for r in connected(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in e if a != b for v in (a, b)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_links_against_brute_force(spark):
    rnd = random.Random(2)
    base = [sorted(rnd.sample(range(1000), 40)) for _ in range(12)]
    sets = []
    for b in base:
        for k in range(5):
            s = set(b) - set(rnd.sample(b, k)) | {2000 + len(sets) * 10 + j for j in range(k)}
            sets.append((len(sets), sorted(s)))
    df = spark.createDataFrame(sets, "class_id long, grams array<long>").withColumn("size", F.size("grams"))
    got = {(r.a, r.b) for r in similarity.jaccard_links(df).collect()}
    want = {(i, j) for i, x in sets for j, y in sets if i < j and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8}
    assert got == want and want


def test_copies_are_one_class(spark):
    d = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c"), (4, None), (5, "  ")], "doc_id long, text string")
    cls = similarity.classes(d, "doc_id", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    assert sorted((r.id, r.class_id) for r in cls.collect()) == [(1, 1), (2, 1), (3, 3)]


def test_large_buckets_stay_linked(spark):
    rows = [(0, "k", i) for i in range(100)] + [(1, "q", i) for i in range(3)]
    got = similarity.bucket_pairs(spark.createDataFrame(rows, "band int, key string, m long"), ["band", "key"], "m")
    pairs = {(r.a, r.b) for r in got.collect()}
    assert len(pairs) <= 2 * 99 + 3 and {(0, i) for i in range(1, 100)} <= pairs and (1, 2) in pairs


def test_multiset_jaccard(spark):
    d = spark.createDataFrame([([1, 1, 2], [1, 2, 2]), ([], [])], "a array<long>, b array<long>")
    assert [r[0] for r in d.select(similarity.multiset_jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0]


def test_minhash_estimates(spark):
    a, b = list(range(0, 200)), list(range(60, 260))
    sets = cut(spark.createDataFrame([(1, a), (2, b)], "class_id long, grams array<long>"))
    est = similarity.estimate(spark.createDataFrame([(1, 2)], "a long, b long"), similarity.signatures(sets)).first().estimate
    assert abs(est - 140 / 260) < 0.12


def test_alignments():
    a, b = ["x", "1", "2", "3", "y"], ["p", "1", "2", "3"]
    assert align.smith_waterman(a, b) == (3, 1, 3, 1, 3) and align.smith_waterman(["a"], ["b"])[0] == 0 and align.smith_waterman([], [])[0] == 0
    assert align.lcs_diff(["a", "b"], ["b", "c"]) == [("-", "a"), ("=", "b"), ("+", "c")]
    sk, shared, holes = align.skeleton([["f(", "1", ")"], ["f(", "2", ")"]])
    assert sk == ["f(", "<param 1: number>", ")"] and (shared, holes) == (2, 1)
    assert align.ransac_offset([5, 9], [5] * 9 + [9]) == 0.2


def test_runs(spark):
    body = "\n".join(f"call_{i}(x)" for i in range(8))
    f = spark.createDataFrame([(1, "a.py", body), (2, "b.py", "pre()\n" + body + "\npost()"), (3, "c.py", "other()")], "file_id long, path string, src string")
    got = runs.shared_runs(runs.line_windows(f, "file_id", F.lit("python"), "src")).collect()
    assert [(r.a, r.b, r.a_pos, r.b_pos, r.lines) for r in got] == [(1, 2, 0, 1, 8)]


def test_spans(spark):
    rnd = random.Random(1)
    mk = lambda n: [("f", s, s + rnd.randrange(-1, 600), i) for i, s in enumerate(rnd.randrange(2000) for _ in range(n))]
    x, y = mk(60), mk(60)
    got = spans.overlap_join(spark.createDataFrame(x, "file string, start int, end int, a int"), spark.createDataFrame(y, "file string, start int, end int, b int"))
    want = sorted((i[3], j[3]) for i in x for j in y if i[2] >= i[1] and j[2] >= j[1] and i[1] <= j[2] and j[1] <= i[2])
    assert sorted((r.a, r.b) for r in got.collect()) == want


def test_ignores():
    with pytest.raises(ValueError):
        temporal.check_ignores([{"paths": ["a"], "reason": " "}])
    with pytest.raises(ValueError):
        temporal.check_ignores([{"reason": "x"}])
    with pytest.raises(ValueError):
        temporal.check_ignores([{"reason": "x", "path": "y"}])


def test_diff_ranges():
    d = "--- a/x.py\n+++ b/x.py\n@@ -3,2 +3 @@\n--- looks like a header\n-b\n+c\n@@ -9,0 +9,2 @@\n+n\n+m\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+z\n"
    assert state.changed_ranges(d) == [("x.py", 3, 4), ("x.py", 10, 9)]


def test_query_terms(spark):
    for bad in ("nope=1", "scope=weird", "members>x", "members>=3", "sort=age", "top=-1", "at=x", "path>3", "plain"):
        with pytest.raises(Q.QueryError):
            Q.parse([bad])
    q = Q.parse(["scope!=test", "members>2", "top=0", "sort=copies"])
    assert len(q.filters) == 2 and q.top == 0 and q.sort == "n_members"


def test_python_units(spark):
    src = "def f(a, b):\n    t = 0\n    for x in a:\n        t += x * b\n    if t > 3:\n        t = t - 1\n    return t\n"
    other = src.replace("t", "q").replace("ref", "def").replace("reqrn", "return")
    f = spark.createDataFrame([(1, "a.py", src), (2, "b.py", "def g(u, v):" + src[len("def f(a, b):") :].replace(" a:", " u:").replace("* b", "* v")), (3, "c.py", "def broken("), (4, "d.py", None)], "file_id long, path string, src string")
    assert other
    c = C.exact_clones(C.python_units(f)).collect()
    assert len(c) == 1 and c[0].members == 2 and c[0].first_path == "a.py"


def test_metrics(spark):
    d = spark.createDataFrame([(0.9, True), (0.8, True), (0.1, False), (0.1, False)], "score double, good boolean")
    r = metrics.ranking(d).first()
    assert (r.auc, r.average_precision) == (1.0, 1.0) and metrics.recall_at(d, 0.95).first().recall == 1.0
    t = spark.createDataFrame([(0.5, True), (0.5, False)], "score double, good boolean")
    assert metrics.ranking(t).first().auc == 0.5
    e = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.8), (0, 2, 1, 0.8)], "component long, p long, g long, weight double")
    assert sorted((r.p, r.g) for r in metrics.match_pairs(e).collect()) == [(1, 2), (2, 1)]
    s = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", "a")], "id long, fp string, behaviour string")
    assert metrics.soundness(s).first().violations == 1 and metrics.completeness(s).first().met == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("print(1)\n")
    (tmp_path / "a" / "y.min.js").write_text("x")
    (tmp_path / "n.txt").write_text("no")
    f = state.discover(spark, [str(tmp_path)], exclude=["*.min.js"]).collect()
    assert [(r.file_id, r.lang, r.src) for r in f] == [(0, "python", "print(1)\n")]
    (tmp_path / "c.toml").write_text("[query]\ntop = 3\n")
    assert state.settings(str(tmp_path / "c.toml")) == {"top": 3}
    (tmp_path / "d.toml").write_text("[query]\ntops = 3\n")
    with pytest.raises(ValueError):
        state.settings(str(tmp_path / "d.toml"))
    m = spark.createDataFrame([("f", "p", "d")], "family_id string, path string, digest string")
    state.write_baseline(m, str(tmp_path / "base"))
    assert [tuple(r) for r in state.read_baseline(spark, str(tmp_path / "base")).collect()] == [("f", "p", "d")]
    r = state.sarif(spark.createDataFrame([("f", "exact", "p", 1, 2)], "family_id string, tier string, file string, start int, end int")).first().result
    assert '"version": "2.1.0"' in state.sarif_document([r])


def test_streaming(spark, sf, tmp_path):
    from twinfold.streaming import incremental as I

    src = tmp_path / "in"
    spark.createDataFrame([(1, "A b"), (2, "a  b"), (3, "c")], "doc_id long, text string").coalesce(1).write.parquet(str(src))
    s = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    q = I.match_batches(s, str(tmp_path / "known"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert [(r.doc_id, r.first_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 1)]
    ev = spark.read.parquet(f"{sf}/events.parquet")
    st = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    w = I.windowed_counts(st, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == ev.count()


def test_anchors(spark):
    from twinfold.operators import anchors as A

    u = spark.createDataFrame([(1, [(7, 30), (8, 5)]), (2, [(7, 25)]), (3, [(8, 5)]), *((i, [(9, 40)]) for i in range(10, 18))], "unit_id long, anchors array<struct<hash:long,weight:int>>")
    assert [tuple(r) for r in A.rare_anchor_pairs(u).collect()] == [(1, 2, 25)]
    s = spark.createDataFrame([(20,), (80,)], "w int").select(A.anchor_score(F.col("w")))
    assert [round(r[0], 4) for r in s.collect()] == [0.72, 0.81]
    v = spark.createDataFrame([(1, [4, 3, 2, 1], True), (2, [1, 2, 3, 4], True), (3, [1, 2, 3, 4], False), (4, [1, 1], True)], "unit_id long, value array<long>, exact_safe boolean")
    assert sorted(tuple(r) for r in A.value_classes(v).collect()) == [(1, 1, 2), (2, 1, 2)]
    big = list(range(100, 110))
    schema = "unit_id long, path string, start_line int, end_line int, token_count int, value array<long>, returns array<long>, cond_sinks array<long>, called_helper_returns array<long>, anchors array<struct<hash:long,weight:int,line_start:int,line_end:int>>, pure_single_return boolean, used_length_contract boolean, exact_safe boolean"
    rows = [
        (1, "h.py", 1, 5, 25, big, [5], [100], [], [], True, False, True), (2, "c.py", 1, 50, 90, [*big, 5], [], [], [], [(5, 30, 10, 20)], False, False, True),
        (3, "d.py", 1, 50, 90, [*big, 5], [], [], [5], [(5, 30, 10, 20)], False, False, True), (4, "e.py", 1, 50, 90, [1], [], [], [], [(5, 30, 10, 20)], False, False, True), (5, "f.py", 30, 50, 90, big, [], [], [], [(5, 30, 10, 20)], False, False, True),
    ]
    assert [tuple(r) for r in A.reinvented(spark.createDataFrame(rows, schema)).collect()] == [(2, 1, 5)]
    lit = lambda *x: [("int" if isinstance(v, int) else "float", str(v)) for v in x]
    m = spark.createDataFrame([("f", "py", "F", lit(1, 2)), ("f", "py", "F", lit(1, 3.5)), ("g", "py", "F", lit(1, 2)), ("g", "py", "F", lit(2, 3)), ("h", "py", "F", lit(1)), ("h", "go", "F", lit(2))], "family_id string, lang string, kind string, literals array<struct<kind:string,value:string>>")
    assert [tuple(r) for r in A.abstraction(m).collect()] == [("f", 1, ["float", "int"], True)]
