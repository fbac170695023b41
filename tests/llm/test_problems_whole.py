"""Results are whole: passages, markers and errors that used to be passed over."""

import random

from pyspark.sql import functions as F

from twinfold.llm import p5_handwritten, p7_leaks, p8_truncated
from twinfold.llm.syntax import check

ITEM = [f"item{i}" for i in range(90)]


def leaks(*parts):
    index = p7_leaks.Index([1], [" ".join(ITEM)])
    doc = [w for p in parts for w in p]
    return p7_leaks.scan(index, [[index.vocab.get(w, 0) for w in doc]])[0]


def test_p7_passage_behind_a_longer_equal_block():
    noisy = [f"other{i}" if i in (7, 15, 23) else w for i, w in enumerate(ITEM[:30])]
    assert [(n, e, a, z) for _, n, e, a, z in leaks(ITEM[60:75], noisy)] == [(30, 3, 15, 45)]


def test_p7_every_passage_of_an_item():
    gap = ["between"] * 20
    assert [(n, a, z) for _, n, _, a, z in leaks(ITEM[:40], gap, ITEM[:40])] == [(40, 0, 40), (40, 60, 100)]
    assert [(n, a, z) for _, n, _, a, z in leaks(ITEM[50:85], gap, ITEM[:35])] == [(35, 0, 35), (35, 55, 90)]


def test_p7_dropped_and_added_words():
    dropped = [w for i, w in enumerate(ITEM[:50]) if i not in (12, 33)]
    added = dropped[:20] + ["new"] + dropped[20:]
    assert [(n, e) for _, n, e, _, _ in leaks(["x"], added, ["y"])] == [(50, 3)]


def test_p5_marker_behind_a_long_licence():
    licence = "\n".join("// This bundled licence has many words, line %d." % i for i in range(2000))
    assert p5_handwritten.says_generated(p5_handwritten.head_comment(licence + "\n// Code generated by a tool. DO NOT EDIT.\nvar x = 1\n"))
    assert len(p5_handwritten.head_comment("//\n" * 100_000 + "// end\ncode\n")) < 20


def test_p1_ruby_interpolation():
    for inner in ("a + ", "foo(1, ", "x y z)", "def"):
        for text in ('"a #{%s} b"', "/a #{%s} b/", "%%W[a #{%s} b]", "`a #{%s}`", ':"a #{%s}"', "<<~T\n  a #{%s} b\nT", '"#{"#{%s}"}"'):
            assert check("rb", "x = " + text % inner + "\n") is not None, (text, inner)
    for inner in ("", "a", "a ? 'b}' : \"c\"", "h.map { |k, v| \"#{k}=#{v}\" }.join(', ')", "x.gsub(/}/, '')", "if a then b else c end", "@a; b"):
        for text in ('"a #{%s} b"', "/a #{%s} b/", "%%W[a #{%s} b]", "<<~T\n  a \\#{ #{%s} b\nT"):
            assert check("rb", "x = " + text % inner + "\n") is None, (text, inner)
    assert check("rb", "x = <<~'T'\n  #{a + }\nT\n") is None


def test_p7_passage_that_stands_in_an_item_many_times():
    passage = [f"rep{i}" for i in range(40)]
    for times in range(1, 11):
        item = [w for k in range(times) for w in [*passage, f"gap{k}"]]
        index = p7_leaks.Index([1], [" ".join(item)])
        doc = ["lead"] * 7 + passage + ["end"] * 5
        got = p7_leaks.scan(index, [[index.vocab.get(w, 0) for w in doc]])[0]
        assert [(n, a, z) for _, n, _, a, z in got] == [(40, 7, 47)], times


def test_p7_two_passages_at_any_distance():
    for gap in (0, 1, 5, 20, 40, 60, 65, 66, 80, 200):
        got = leaks(ITEM[50:85], ["between"] * gap, ITEM[:35])
        assert [(n, a, z) for _, n, _, a, z in got] == [(35, 0, 35), (35, 35 + gap, 70 + gap)], gap


def test_p7_no_run_of_thirty_words_is_lost():
    rng = random.Random(11)
    index = p7_leaks.Index([1], [" ".join(ITEM)])
    docs = []
    for _ in range(10_000):
        start = rng.randrange(len(ITEM) - 29)
        run = list(ITEM[start : start + 30])
        for k in sorted(rng.sample(range(30), 3), reverse=True):
            kind = rng.randrange(3)
            if kind == 0:
                run[k] = "changed"
            elif kind == 1:
                del run[k]
            else:
                run.insert(k, "added")
        docs.append([f"a{i}" for i in range(rng.randrange(8))] + run + [f"z{i}" for i in range(rng.randrange(8))])
    got = p7_leaks.scan(index, [[index.vocab.get(w, 0) for w in d] for d in docs])
    assert all(got)


def test_p7_instruction_of_any_length(spark):
    lead = " ".join(f"lead{i}" for i in range(400))
    items = spark.createDataFrame([(i, f"{lead} " + " ".join(f"own{i}x{k}" for k in range(40))) for i in range(8)], "k long, t string")
    assert {(r.k, r.lead) for r in p7_leaks.with_openings(items, 8).collect()} == {(i, 400) for i in range(8)}


def test_p7_many_leaks_in_one_document():
    got = leaks(*(ITEM[:40] for _ in range(300)))
    assert len(got) == 300 and all(n == 40 for _, n, *_ in got)


def test_p8_sample_is_a_bound(spark):
    own = F.concat(F.lit("Text number "), F.col("id").cast("string"), F.lit(" says something of its own and then it ends here."))
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 4 > 0, F.lit("A boilerplate text of some words that most records hold.")).otherwise(own).alias("t"), F.lit(0).alias("at"))
    assert 0 < p8_truncated.sampled(rows, 20_000, 200).count() <= 200
    same = rows.withColumn("k", F.lit(7).cast("long"))  # keys that are all equal: all are picked or none
    got = p8_truncated.sampled(same, 20_000, 200).limit(200).count()
    assert got <= 200


def test_p8_limits_are_of_distinct_texts(spark):
    texts = [("s", "x" * 100)] * 40 + [("s", f"{i:03}" + "y" * 197) for i in range(20)] + [("s", f"{i:03}" + "z" * 297) for i in range(20)] + [("s", "w" * (400 + i)) for i in range(50)]
    d = spark.createDataFrame(texts, "source string, text string")
    got = p8_truncated.limits(p8_truncated.lengths(d, "text", "source")).collect()
    assert [sorted(r._limits) for r in got] == [[200, 300]]


def test_p1_ambiguous_nests_of_any_depth():
    for n in (15, 60, 300):
        assert check("js", "x=" + "(a=" * n + "1" + ")" * n + ";") is None
        assert check("ts", "x = " + "a<b>(" * n + "1" + ")" * n + ";") is None
        assert check("c", "int x = " + "(a)-" * n + "1;") is None
        assert check("js", "x=" + "(a=" * n + "1" + ")" * (n - 1) + ";") is not None
        assert check("c", "int x = " + "(a)-" * n + ";") is not None


def test_p1_forgetting_changes_nothing(monkeypatch):
    from twinfold.llm.syntax import tables

    src = "".join(f"function f{i}(a) {{ " + "if (a) { " * (i % 9) + f"b({i}); return a ? [1, {{c: a}}] : a\n" + "} " * (i % 9) + "}\n" for i in range(900))
    whole = check("js", src), check("js", src[:-2])
    monkeypatch.setattr(tables, "REMEMBERED", 3)
    assert (check("js", src), check("js", src[:-2])) == whole and whole[0] is None and whole[1]


def test_p5_layout():
    limits = p5_handwritten.THRESHOLDS["js"]
    judged = lambda text: p5_handwritten.by_layout(p5_handwritten.layout(text, limits.long_line), limits)
    licence = "/* " + "\n * a licence of many short lines".join([""] * 30) + " */\n"
    packed = "!function(){" + "".join(f"var q=function(e,t){{for(;e<t;)e*={i%7};return e+'x'}};" for i in range(60)) + "}();\n"
    assert judged(packed) == judged(licence + packed) == (True, False, False)
    assert judged("const a = [\n" + "  12, 'x', 0x1f,\n" * 50 + "];\n") == (False, True, False)
    blob = "".join(chr(65 + i * 7 % 26) + chr(97 + i * 5 % 26) + str(i % 10) for i in range(400))
    assert judged(f'const a = "{blob}";\n') == (False, True, False)
    assert not p5_handwritten.is_encoded("+".join(f"a{i}" for i in range(40))) and not p5_handwritten.is_encoded("a_very_long_name_of_a_function_that_says_what_it_does_2")
    wide = "".join(f"register(handlers.item{i}, {{ name: 'item{i}', run: () => step({i}), text: '{'long text ' * 25}' }});\n" for i in range(12))
    assert judged(wide)[2]  # lines of any length count as numbered
    assert judged("function f(x) {\n  return x + 1;\n}\n") == (False, False, False)


def test_p5_tune(spark):
    rows = [("py", 80, 30.0, 0.2, x, 0.0, 0.0) for x in (0.1, 0.3, 0.7, 0.9)] + [("go", 80, 30.0, 0.2, 0.1, 0.0, 0.0), (None, 80, 30.0, 0.2, 0.6, 0.0, 0.0)]
    stats = spark.createDataFrame(rows, "language string, longest int, mean_line double, space double, literal double, encoded double, numbered double")
    got = {r.language: r for r in p5_handwritten.tune(stats).collect()}
    assert got["py"].literal == 0.5 and got["go"].literal == 0.5 and got["go"].n_files == 1 and set(got) == {"py", "go"}
