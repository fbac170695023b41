from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinfold.functions import declarative as D
from twinfold.functions import scalars as V
from twinfold.functions import text as T


def one(spark, rows, kind, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, kind).select(*cols).collect()]


def test_normalise(spark):
    rows = [("* a **b**\n> `c` [d](http://x)",), ("- a __b__\n> c d",), ("ＡＢＣ！",), ("| a | b |\n|---|---|\n| 1 | 2 |",), ("",), (None,)]
    got = [r[0] for r in one(spark, rows, "t string", T.normalize_text(F.col("t")))]
    assert got[0] == "a b d" and got[1] == "a b c d" and got[2] == "abc!" and got[3] == "a b 1 2" and got[4] == "" and got[5] is None


def test_tokens_and_grams(spark):
    t, g, n = one(spark, [("안녕하세요",)], "t string", T.word_tokens(F.col("t")), T.char_ngrams(F.col("t"), 3), T.gram_size(F.col("t")))[0]
    assert len(t) == 5 and len(g) == 3 and n == 3
    assert one(spark, [("ab",), ("",)], "t string", T.char_ngrams(F.col("t"), 3)) == [(["ab"],), ([],)]
    assert one(spark, [(["a", "b", "c"],), (["a"],), ([],)], "t array<string>", T.shingles(F.col("t"), 2)) == [(["a b", "b c"],), (["a"],), ([],)]


def test_paths(spark):
    rows = [("src/tests/a.py",), ("a/test_b.py",), ("a/gen/x.go",), ("node_modules/q/i.js",), ("src/protest.py",)]
    p = F.col("p")
    got = one(spark, rows, "p string", T.is_test_path(p), T.is_generated_path(p), T.is_dependency_path(p), T.module_of(p), T.language_of(p))
    assert [g[0] for g in got] == [True, True, False, False, False] and got[2][1] and got[3][2] and got[0][3:] == ("src/tests", "python")


def test_trivial_lines(spark):
    got = one(spark, [("} else {",), ("return x",), ("});",), ("",)], "t string", T.is_trivial_line(F.col("t")))
    assert [g[0] for g in got] == [False, False, True, True]


def test_integers(spark):
    a, b = F.col("a"), F.col("b")
    rows = [(-5, 3), (5, -3), (-5, -3), (7, 0), (-9007199254740993, 1)]
    got = one(spark, rows, "a long, b long", V.trunc_div(a, b), V.floor_div(a, b), V.trunc_mod(a, b), V.floor_mod(a, b))
    assert got == [(-1, -2, -2, 1), (-1, -2, 2, -1), (1, 1, -2, -2), (None,) * 4, (-9007199254740993, -9007199254740993, 0, 0)]


def test_wrapping_matches_two_complement(spark):
    big = [(2**63 - 1, 2**63 - 1), (-(2**63), -1), (123456789012345678, -987654321098765432), (0, 5), (-(2**63), -(2**63))]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    a, b = F.col("a"), F.col("b")
    got = one(spark, big, "a long, b long", V.wrap_add(a, b), V.wrap_sub(a, b), V.wrap_mul(a, b))
    assert got == [(wrap(x + y), wrap(x - y), wrap(x * y)) for x, y in big]


def test_lists(spark):
    x = F.col("x")
    lit = lambda n: F.lit(n).cast("long")
    got = one(spark, [([3, 1, 2],), ([],)], "x array<long>", V.list_sum(x), V.reduce_list(x, lambda a, y: a + y), V.keys_of_list(x), V.list_range(lit(0), lit(5), lit(2)), V.list_range(lit(0), lit(5), lit(0)))
    assert got == [(6, 6, [0, 1, 2], [0, 2, 4], None), (0, None, [], [0, 2, 4], None)]


def test_css():
    assert D.style_hash("color: #fff; margin: 0px 0px") == D.style_hash("margin:0;color:white")
    assert D.style_hash("color:red;color:blue") == D.style_hash("color:#0000FF")
    assert D.style_hash("margin:0;margin-top:1px") != D.style_hash("margin-top:1px;margin:0")
    assert [c for c, _ in D.css_rules("@media print { a { color: red } } b { color: red }")] == ["@media print", ""]


def test_dom():
    a, b = D.dom_hashes('<p class="x y" id=q>a <b>c</b></p>'), D.dom_hashes('<p id="q" class="y  x">a\n<b>c</b></p>')
    assert a == b and D.dom_hashes("<p>a</p><p>b</p>") != D.dom_hashes("<p>b</p><p>a</p>")
    assert D.dom_hashes("") and D.dom_hashes("<b>open <i>never closed")
    r = D.regions('<script lang="ts">let a</script>\n<!-- <script>no</script> -->\n<style lang="scss">x</style><style>b{}</style>')
    assert [(k, n) for k, n, _ in r] == [("typescript", 1), ("css", 3)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_html_never_fails(s):
    D.dom_hashes(s)
    D.regions(s)
