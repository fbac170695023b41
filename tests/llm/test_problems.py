"""Each operator on small fixtures: nulls, empty and long texts, ties, repeated
rows, empty tables, clashing column names; results against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.llm import p1_parse, p2_groups, p3_ranking, p4_distinctive, p5_handwritten, p6_encode, p7_leaks, p8_truncated
from twinfold.llm.syntax import check

VALID = {
    "py": ["", "def f(a, /, b=1, *, c: int = 2, **k) -> int:\n    return f'{a!r:>{b}} {{x}}'\n", "match x:\n    case {'a': [b, *_]} | C(d=1) if b: pass\n", "x = [i async for i in y if (z := i)]\n", "a: int\nb, *c = d = 1,\n", "if 1:\n\tx\n"],
    "js": ["", "a\nb\n", "x = a / b / c; y = /[/]\\/(/g.test(z)", "`a${`b${c}`}`", "for (const [a, b] of c) ;", "({a, b = 1}) => a ?? b", "class A extends B { static #x = 1; get y() { return this.#x } }", "if (a) b; else c", "return_: for (;;) { break return_ }", "async function* f() { yield* g(); await h }"],
    "ts": ["", "const f = <T extends U>(a: T, b?: Map<string, Array<number>>): a is V => a < b", "type A = { readonly [k in keyof B]?: C[k] } | `x${string}`", "abstract class A<T> implements B { private readonly x!: number; constructor(public y: string) { super() } }", "declare module 'x' { export function f(a: number): void }", "enum E { A = 1, B }\nlet x = y as unknown as Z[];"],
    "java": ["", "package a.b; import static c.D.*; @X(y = 1) public final class A<T extends B & C> { int[] a = {1, 2}, b; A() { this(1); } <U> U f(U... u) throws E { return u -> u; } }", "record P(int x) { P { if (x < 0) throw new E(); } } sealed interface S permits P {}", "class A { void f() { for (var x : y) switch (x) { case 1 -> { } default -> g(); } int z = (int) -1; List<?>[] l = new List<?>[3]; A::new; } }".replace(" A::new;", "")],
    "go": ["package a\n", "package a\nimport (\n\t\"b\"\n)\nfunc (t *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok {\n\t\treturn\n\t}\n\tfor i := range 10 { go func() { c <- 1 }() }\n\tswitch x := y.(type) {\n\tcase int: _ = []T{{1}, {2}}\n\t}\n\treturn T{a: 1}.x, nil\n}\n"],
    "c": ["", "#define BEGIN {\n#define END }\nint f(void) BEGIN return 0; END\n", "#if 0\n((( broken\n#else\nint x;\n#endif\n", "typedef struct a { int b : 3; } *c; int (*f)(int, ...) = 0; static const char *s[] = {\"a\" \"b\", [2] = 0};", "void f(int n) { size_t i; T *p = (T *)q; for (int j = 0; j < n; j++) x: p->a[j]++, (*g)(j); do ; while (0); }"],
    "rs": ["", "use a::{b, c::*};\npub fn f<'a, T: X + 'a>(x: &'a mut [T]) -> Option<Vec<Vec<T>>> where T: Copy { if let Some(y) = x && y { return None; } match x { [a, .., b] if a > b => {} _ => () } let c = |z| z?; a..=b }", "macro_rules! m { ($($x:expr),*) => { [$($x),*] }; }\nconst S: &str = r#\"a\"b\"#; /* a /* b */ c */", "impl<T> A for B<T> { type C = D; fn f(self: &Self) { loop { break 'a; } } }".replace(" break 'a;", " break;")],
    "rb": ["", "def a(b, c = 1, *d, e:, **f, &g)\n  puts \"x #{b ? \"y\" : 'z'}\" unless c\n  d.map { |x| x + 1 }.each do |y|\n    yield y\n  end\nrescue E => e\n  raise\nensure\n  close\nend\n", "x = <<~T\n  a #{1}\nT\nclass A < B\n  attr_reader :a, :b\nend\n", "case x\nwhen 1, 2 then :a\nelse nil\nend\nwhile true do break end\n", "A = %w[a b].freeze\nh = { a: 1, 'b' => 2 }\nputs [1] if h[:a]\n"],
}
INVALID = {
    "py": ["def f(:\n", "print 'x'\n", "x = (1,\n", "if 1:\nx\n", "<<<<<<< HEAD\nx = 1\n", "a = 012\n", "def f(a, b]:\n    pass\n", "f'{a'\n"],
    "js": ["function f( {", "let a: number = 1", '{"a": 1, "b": 2}', "a = 'x", "=======\n", "class { }", "if (a {", "log(“x”)", "`a${b"],
    "ts": ["function f(a: number)): void {}", "const m = new Map&lt;string&gt;();", "<!DOCTYPE html>", "interface A { b: }"],
    "java": ["class A { void f() { g( } }", "int x = 1", "class A { int f() { return 1 } }", "class A {"],
    "go": ["", "func f() {}\n", "package a\nfunc f(a int] {}\n", "package a\nx := 1\n"],
    "c": ["int f( {", "int x = ;", "#ifdef A\nint x;\n", "int f(void) { return 0;", "import os\n"],
    "rs": ["fn f( {}", "let x = 1;", "fn f() { a b }", "struct A { b: u8"],
    "rb": ["def a(b\n", "class A\n", "def (x)\nend\n", "x = [1, 2\n", "end\n", "{ a: 1"],
}


@pytest.mark.parametrize("ext", sorted(VALID))
def test_grammars(ext):
    for s in VALID[ext]:
        assert check(ext, s) is None, (ext, s, check(ext, s))
    for s in INVALID[ext]:
        assert check(ext, s) is not None, (ext, s)


def test_python_grammar_agrees_with_the_compiler(sf):
    import ast
    import glob
    import warnings

    warnings.simplefilter("ignore")
    for f in sorted(glob.glob("/opt/py313/lib/python3.13/*.py"))[:60]:
        s = open(f, encoding="utf8", errors="replace").read()
        if len(s) < 40000:
            assert (check("py", s) is None) == bool(ast.parse(s)), f


def test_truncation_is_found_everywhere():
    src = VALID["py"][1] + "".join(f"def g{i}(a):\n    return [a, {{'b': {i}}}]\n" for i in range(3))
    opens = [k for k in range(len(src)) if src[:k].count("(") > src[:k].count(")")]
    assert opens and all(check("py", src[:k]) for k in opens)


def test_p1(spark):
    rows = [(1, "r", "a.py", "x = 1\n"), (2, "r", "b.PY", "x = (\n"), (3, None, "c.rs", None), (4, "r", "d.txt", "((("), (5, "r", None, "x"), (6, "q", "e.js", ""), (6, "q", "e.js", "("), (7, "q", "big.py", "a = [\n" + "1, " * 60000 + "]\n")]
    f = spark.createDataFrame(rows, "file_id long, repo string, path string, src string").withColumn("valid", F.lit("clash")).withColumn("k", F.lit(1))
    got = [(r.file_id, r.valid, r.line) for r in p1_parse.parse_files(f, "file_id", "path", "src").collect() if r.valid is not None]
    assert len(got) == 5 and set(got) == {(1, True, None), (2, False, 2), (6, True, None), (6, False, 1), (7, True, None)}
    assert p1_parse.parse_files(f.limit(0), "file_id", "path", "src").count() == 0


def _union_find(edges, extra):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            p[find(a)] = find(b)
    groups = {}
    for x in [*p, *extra]:
        groups.setdefault(find(x), []).append(x)
    return {x: min(m, key=str.encode) for m in groups.values() for x in m}


@pytest.mark.parametrize("core, numbers", [(p2_groups.CORE, 0), (0, 0), (0, 5)])
def test_p2_against_union_find(spark, monkeypatch, core, numbers):
    if numbers:  # so few numbers that paths share them
        monkeypatch.setattr(p2_groups, "number", lambda c: F.pmod(F.xxhash64(c), F.lit(numbers)))
    rnd = random.Random(7)
    e = [(f"p{rnd.randrange(150):03}", f"p{rnd.randrange(150):03}") for _ in range(90)]
    e += [(f"chain{i:03}", f"chain{i + 1:03}") for i in range(70)]  # one long path
    e += [(f"ring{i:02}", f"ring{(i + 1) % 31:02}") for i in range(31)] + [(f"ring{i:02}z", f"ring{(i + 1) % 4:02}z") for i in range(4)]
    e += [("hub", f"leaf{i}") for i in range(120)] + [("hub", "é"), ("é", "Ω")]
    e += [(f"k{i}", f"k{j}") for i in range(7) for j in range(i)]  # a core that is not thin
    e += [(f"t{i}", f"t{(i - 1) // 2}") for i in range(1, 40)]
    e += [e[0], e[0], ("x", "x"), (None, "p001"), ("p002", None), (e[3][1], e[3][0])]
    alone = ["alone", "x", None]
    v = spark.createDataFrame([(a,) for p in e for a in p] + [(a,) for a in alone], "path string").withColumn("group_path", F.lit("clash"))
    got = {r.path: r.group_path for r in p2_groups.group_paths(v, spark.createDataFrame(e, "a string, b string"), core).collect()}
    assert got == _union_find(e, {x for p in e for x in p if x} | {"alone", "x"})
    empty = spark.createDataFrame([], "a string, b string")
    assert [tuple(r) for r in p2_groups.group_paths(spark.createDataFrame([("a",), ("a",)], "path string"), empty).collect()] == [("a", "a")]
    assert p2_groups.group_paths(v.limit(0), empty).count() == 0


def test_p3_against_all_pairs(spark):
    rnd = random.Random(5)
    rows = [(f"f{i:02}", rnd.choice([1, 2, 5000, None]), rnd.choice([0.1, 0.9, float("nan"), rnd.random()]), rnd.random() if i % 5 else None) for i in range(40)]
    scores = (("a", 1.0, True), ("b", 2.0, False), ("c", 1.0, True))
    got = {r.key: r for r in p3_ranking.net_flow(spark.createDataFrame(rows, "key string, a long, b double, c double"), "key", scores).collect()}
    flows = {r[0]: [0.0, 0.0, 0.0] for r in rows}
    for k, (_, _, up) in enumerate(scores):
        x = {r[0]: (r[k + 1] if up else -r[k + 1]) for r in rows if r[k + 1] is not None and r[k + 1] == r[k + 1]}
        n = len(x)
        m = {i: 2 * sum(w < v for w in x.values()) + sum(w == v for w in x.values()) for i, v in x.items()}
        q, p = round(n * 0.1), max(n, round(n * 0.1) + 1)
        pref = lambda d: max(0.0, min(1.0, (d - q) / (p - q)))
        for i in x:
            flows[i][k] = sum(pref(m[i] - m[j]) - pref(m[j] - m[i]) for j in x) / (n - 1)
    for i, (fa, fb, fc) in flows.items():
        assert abs(got[i].net_flow - (fa + 2 * fb + fc) / 4) < 1e-8
    order = sorted(got, key=lambda i: (-got[i].net_flow, i))
    assert [got[i]["rank"] for i in order] == list(range(1, 41))
    one = p3_ranking.net_flow(spark.createDataFrame(rows[:1], "key string, a long, b double, c double"), "key", scores).first()
    assert (one.net_flow, one["rank"]) == (0.0, 1)
    assert p3_ranking.net_flow(spark.createDataFrame([], "key string, a long, b double, c double"), "key", scores).count() == 0


def test_p4(spark):
    scans = spark.createDataFrame([(1, "a", 9, 10), (1, "a", 9, 10), (1, "b", 1, 10), (1, None, 5, 10), (2, "a", 4, 5)], "s long, line string, df int, n int")
    rec = spark.createDataFrame([("x", ["a", "b", "b", None]), ("x", ["a", "b", "b", None]), ("y", []), ("z", None), ("w", ["new", "a"])], "record string, terms array<string>").withColumn("df", F.lit("clash"))
    counts, total = p4_distinctive.term_counts(scans, "s", "line", "df", "n")
    got = {(r.record, r.term): r for r in p4_distinctive.distinctive(rec, "record", "terms", counts, total).collect()}
    assert set(got) == {("x", "a"), ("x", "b"), ("w", "new"), ("w", "a")} and got["x", "a"].df == 13 and got["x", "b"].tf == 2 and got["w", "new"].df == 0
    assert abs(sum(r.score**2 for k, r in got.items() if k[0] == "x") - 1) < 1e-6 and got["x", "b"].score > got["x", "a"].score


def test_p5(spark):
    acc = "".join(f"def get_a{i}(m):\n    return m.f[{i}]\n\n" for i in range(8))
    hand = "def f(x):\n    # writes the file\n    return open(x).read()\n\n\ndef g(y):\n    return y + 1\n"
    mini = "!function(){" + "".join(f"var a{i}=function(e,t){{return e>{i}?t:e*2}};" for i in range(40)) + "}();\n"
    data = "X = [\n" + "    1, 2, 3, 4, 5,\n" * 40 + "]\n"
    prose = "HELP = '" + "a long text about many things " * 60 + "'\n" + hand
    lic = "# This file is part of repo.\n# Use and copying are allowed under the terms in LICENSE.txt\n"
    rows = [
        (1, "a/x.py", acc), (2, "a/y.py", "# Code generated by tool 1.2. DO NOT EDIT.\n" + hand), (3, "a/z.js", mini), (4, "a/d.py", data), (5, "vendor/q/f.py", hand), (6, "lib/zlibx/i.py", hand), (7, "b/c.py", "# zlibx 1.2.3\n# Copyright (c) the zlibx authors.\n" + hand),
        (8, "src/vendor_portal/f.py", lic + hand), (9, "s/w.py", "# Writes the generated report; not itself generated code.\n" + hand), (10, "s/p.py", prose), (11, "s/e.py", ""), (12, None, None), (13, "s/t.py", "T = [1, 2, 3]\n" + hand), (13, "s/t.py", "T = [1, 2, 3]\n" + hand),
        (14, "s/o.py", "# Do not edit the order of these steps.\n" + hand),
    ]
    f = spark.createDataFrame(rows, "file_id long, path string, src string").withColumn("kind", F.lit("clash")).withColumn("n", F.lit(1))
    from twinfold.operators.scale import cut

    got = p5_handwritten.vendored_by_name(cut(p5_handwritten.classify(f, "file_id", "path", "src"))).collect()
    kinds = {r.id: r.kind for r in got}
    assert len(got) == len(rows)
    assert {k: v for k, v in kinds.items() if v} == {1: "generated", 2: "generated", 3: "minified", 4: "data", 5: "vendored", 6: "vendored", 7: "vendored"}


def test_p6(spark):
    from tokenizers import Tokenizer

    enc = p6_encode.encoder(p6_encode.load(p6_encode.vocabulary_path()))
    hf = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    hf.encode_special_tokens = True
    rnd = random.Random(3)
    texts = ["", " ", "<|endoftext|> x", "a\r\n\tb", "it's  'fine'", "한국어 문장", "\u200b🏽", *("".join(rnd.choice(a) for _ in range(n)) for a in ("a", "ab", "한국", "01", "-=*", "word it's, 12\n ") for n in (40, 300))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (0, "")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("k", F.lit(0))
    for long in (1 << 16, 32):
        got = {r.doc_id: r.ids for r in p6_encode.encode(docs, "doc_id", "text", p6_encode.vocabulary_path(), long).collect()}
        assert got.pop(99) is None and got[0] == []
        assert got == {i: hf.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
        assert all(enc.decode(x) == texts[i] for i, x in got.items())


def test_p6_unsplit_words_come_by_tree_concatenation(spark, sf):
    enc = p6_encode.encoder(p6_encode.load(p6_encode.vocabulary_path()))
    got = p6_encode.p6_unsplit(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.regexp_replace("text", r"\P{L}+", "").alias("text")).collect()}
    assert len(got) == len(text) and sum(len(t or "") > 256 for t in text.values()) > 20
    assert all(r.ids == (None if text[r.doc_id] is None else enc.encode_ordinary(text[r.doc_id])) for r in got)


def _item(n, seed=0):
    return [f"w{seed}x{i}" for i in range(n)]


def test_p7(spark):
    lead = "Read this and answer from it alone please".split()
    items = [(i, " ".join(lead + _item(90, i))) for i in range(12)] + [(100, " ".join(_item(50, 100) + _item(40, 1))), (101, None), (102, "short")]
    w = items[1][1].split()[8:]
    noisy = [x for i, x in enumerate(w[20:70]) if i % 11 != 5]
    far = [x if i % 4 else "zz" for i, x in enumerate(w)]
    docs = [
        (1, "Intro. " + "\n> ".join("**" + x.upper() + "**," for x in w[5:40]) + " end"), (2, " ".join(w[5:30])), (3, "a b " + " ".join(noisy)), (4, " ".join(far)), (5, " ".join(lead * 6)), (6, None), (7, ""), (8, "a b " + " ".join(w[50:90])),
        (9, "x " * 200_000 + " ".join(w[5:40])), (1, "Intro. " + " ".join(w[5:40])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash"))
    it = spark.createDataFrame(items + [items[1]], "item_id long, text string")
    s = p7_leaks.leaks(d, "doc_id", "text", it, "item_id", "text")
    hits = {(r.doc_id, r.item_id) for r in s.collect()}
    assert {h for h in hits if h[1] != 100} == {(1, 1), (3, 1), (8, 1), (9, 1)}
    assert {(1, 100), (9, 100)} <= hits and (8, 100) not in hits  # it shares the first 40 words of item 1
    clean = {r.doc_id: r.text for r in p7_leaks.remove_spans(d.filter("doc_id > 1"), "doc_id", "text", s).collect()}
    assert clean[8].strip() == "a b" and clean[2] == docs[1][1] and clean[6] is None
    assert p7_leaks.leaks(d, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_p7_run_against_brute_force():
    rnd = random.Random(9)
    item = list(range(1, 81))
    for _ in range(60):
        n = rnd.randrange(20, 60)
        part = item[10 : 10 + n]
        errors = rnd.randrange(0, 5)
        for _ in range(errors):
            part[rnd.randrange(len(part))] = 0
        got = p7_leaks.best_run(item, [0] * 5 + part + [0] * 5)[0]
        exact = any(sum(x == 0 for x in part[a:b]) * 10 <= b - a for a in range(len(part)) for b in range(a + 30, len(part) + 1))
        if exact:
            assert got >= 27
        elif n < 27:
            assert got == 0


def test_p8(spark, sf):
    base = [r.text for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("text").collect() if r.text and r.text.strip().endswith(".") and not r.text.strip().endswith("..") and len(r.text) > 300]
    rnd = random.Random(2)
    rows, cut = [], set()
    for i, t in enumerate(base):
        t = t.rstrip()
        if i % 6 == 0:
            k = rnd.randrange(120, len(t) - 20)
            while not (t[k - 1].isalpha() and t[k].isalpha()):
                k = rnd.randrange(120, len(t) - 20)
            t = t[:k]
            cut.add(i)
        rows.append((i, t, f"s{i % 3}"))
    rows += [(9001, None, "s0"), (9002, "", None), (9003, " \n", "s1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.score for r in p8_truncated.score(d, "doc_id", "text", "source").collect()}
    assert got[9001] is None and got[9002] is None and got[9003] is None and len(got) == len(rows)
    found = {i for i, s in got.items() if s is not None and s > 0.5}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.03 * len(rows)
    none = p8_truncated.score(d.filter("doc_id > 9000"), "doc_id", "text", "source").collect()
    assert [r.score for r in none] == [None] * 3


def test_p8_fit_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(10, 2000, 8)) for _ in range(400)]
    y = rng.integers(0, 2, 400)
    rows = [np.append(r, 3 if v else 5) for r, v in zip(rows, y)]
    p = p8_truncated.scores(p8_truncated.fit(y, rows, np.ones(400)), rows)
    assert ((p > 0.5) == y).all()
