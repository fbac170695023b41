"""Gates, witnesses, shared lines, counts, sources, options and the command line on
small cases worked out by hand."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from twinfold import options as O
from twinfold.__main__ import main
from twinfold.functions import scalars as V
from twinfold.functions import text as T
from twinfold.operators import align, census, lines, runs, scoring
from twinfold.operators import prose_families as PF
from twinfold.plans import prose, sections
from twinfold.sources import state


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t


def test_diff_is_that_of_the_whole_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        t, got, i, j = longest(a, b), align.lcs_diff(a, b), 0, 0
        for op, line in got:  # equal lines at once, ties delete first
            want = "=" if i < len(a) and j < len(b) and a[i] == b[j] else "-" if i < len(a) and (j == len(b) or t[i + 1][j] >= t[i][j + 1]) else "+"
            assert op == want and line == (b[j] if op == "+" else a[i])
            i, j = i + (op != "+"), j + (op != "-")
        assert (i, j) == (len(a), len(b))
    many = [str(k) for k in range(5000)]
    assert sum(op == "=" for op, _ in align.lcs_diff(many, many[:2500] + ["x"] + many[2500:])) == 5000


def test_shared_lines_and_spots(spark):
    a = ["head", "  x = 1", "tail", "", "end"]
    b = ["head", "  x = 2", "tail", "", "end"]
    c = ["head", "other", "more", "end"]
    assert lines.shared_lines([a, b]) == (["end", "head", "tail"], 4, 1)
    assert lines.shared_lines([a, b, c]) == (["end", "head"], 2, 1)  # both others must have a line
    assert lines.shared_lines([a]) is None
    assert lines.varying_spots(a, b, 10, 20) == [{"param": 1, "a_from": 11, "a_to": 11, "b_from": 21, "b_to": 21, "a_text": "x = 1", "b_text": "x = 2"}]
    assert len(lines.varying_spots([str(i) if i % 2 else "s" for i in range(60)], [f"t{i}" if i % 2 else "s" for i in range(60)])) == lines.SPOTS
    t = lambda *ch, exact=False: lines.touches_shared(a, b, 10, 14, list(ch), exact)
    assert t((11, 11)) is False and t((12, 12)) is True and t((11, 11), exact=True) is True and t((13, 12)) is True and t((99, 99)) is False
    assert lines.touches_shared([str(i) if i % 2 else "s" for i in range(60)], [f"t{i}" if i % 2 else "s" for i in range(60)], 1, 60, [(1, 1)]) is None
    f = spark.createDataFrame([("f", [a, b, c]), ("g", [a])], "family string, members array<array<string>>")
    assert [(r.family, r.rank_lines, r.display, r.params) for r in lines.family_lines(f).collect()] == [("f", ["end", "head"], 2, 1)]


def test_gates_and_channels(spark):
    d = spark.createDataFrame([([1, 2, 3, 4], [9, 8], [7], 0.9, [1, 2, 3, 4], [9, 7], [6])], "va array<int>, la array<int>, ra array<int>, s double, vb array<int>, lb array<int>, rb array<int>")
    c = F.col
    r = d.select(
        scoring.exact(c("va"), c("vb"), F.lit(True), F.lit(True)), scoring.exact(c("va"), c("vb"), F.lit(True), F.lit(False)), scoring.data_gate(c("s"), c("va"), c("la"), c("vb"), c("lb")), scoring.return_gate(c("s"), c("ra"), c("rb")),
        scoring.return_gate(c("s"), F.expr("cast(array() as array<int>)"), c("rb")), scoring.near(F.lit(0.95), F.lit(0.1), F.lit(0.0), F.lit(4), F.lit(None).cast("int")), scoring.near(F.lit(0.5), F.lit(0.4), F.lit(0.0), F.lit(4), F.lit(20)),
        scoring.strict(F.lit(0.1), F.lit(0.1), F.lit(1.0), lambda x: x), scoring.strict(F.lit(0.8), F.lit(0.5), F.lit(0.6), lambda x: F.least(x, F.lit(0.3))), scoring.channel_max(F.lit(None).cast("double"), F.lit(0.4), F.lit(0.6)),
    ).first()
    assert [None if x is None else round(x, 6) for x in r] == [1.0, None, round(1 / 3, 6), 0.8, 0.9, 0.95, 0.72, 0.1, 0.3, 0.6]


def test_group_witness(spark):
    rows = [("e", 1, [4, 3, 2, 1], [1], [], True), ("e", 2, [1, 2, 3, 4], [2], [], True), ("s", 1, [1, 2], [1], [7, 8], False), ("s", 2, [3], [1], [8, 8], True), ("n", 1, [1, 2], [1, 1], [5], True), ("n", 2, [1], [1], [6], True), ("n", 3, [2], [1, 1], [], True)]
    d = spark.createDataFrame(rows, "group_id string, unit_id int, value array<int>, shapes array<int>, anchors array<bigint>, safe boolean")
    got = {r.group_id: tuple(r)[1:] for r in scoring.group_witness(d).collect()}
    assert got == {"e": ("exact", 4, None, None), "s": ("subdag", None, None, None), "n": ("similar", None, 0.5, 0.75)}


def test_pieces(spark):
    d = spark.createDataFrame([(["a", "b", "c"], ["a", "b"], ["b", "c"], [], None)], "p array<string>, x array<string>, y array<string>, e array<string>, n array<string>")
    p, x, y, e, n = (F.col(k) for k in "pxyen")
    r = d.select(V.starts_with(p, x), V.starts_with(x, p), V.ends_with(p, y), V.ends_with(p, x), V.string_contains(p, y), V.string_contains(p, F.array(F.lit("a"), F.lit("c"))), V.string_contains(p, e), V.starts_with(p, e), V.is_empty(e), V.is_empty(n), V.truthy_list(e), V.join_pieces(e, F.array(x, y)), V.length(n)).first()
    assert tuple(r) == (True, False, True, False, True, None, True, True, True, None, False, ["a", "b", "b", "c"], None)


def test_battery_and_behaviour(spark):
    b = {(r.row, r.slot): r.list if r.list is not None else r.number for r in census.battery(spark).collect()}
    assert len(b) == 256 and [b[9, j] for j in range(4)] == [3, 3, [1, 2, 3, 4], [1, 2, 3, 4]] and census.battery(spark, wide=True).count() == 243 * 5
    d = spark.createDataFrame([([1, 1],), ([None, None],), ([1, None],), ([],)], "r array<bigint>")
    assert [x[0] for x in d.select(census.trivial_behaviour(F.col("r"))).collect()] == [True, True, False, True]


def test_neighbours_against_all_pairs(spark):
    rng = random.Random(3)
    keys = [(k, rng.randrange(40)) for k in range(150)]
    order = sorted(keys, key=lambda x: (x[1], x[0]))
    want = {(order[i][0], order[j][0]) for i in range(150) for j in range(i + 1, min(i + 8, 150))}
    assert {tuple(r) for r in census.neighbours(spark.createDataFrame(keys, "k int, o int"), "k", "o", 7).collect()} == want


def test_reachable(spark):
    gold = spark.createDataFrame([("1", "f", 1, 10, "g", 1, 10), ("2", "f", 1, 10, "f", 5, 12), ("3", "f", 1, 10, "z", 1, 2)], "id string, l_file string, l_start int, l_end int, r_file string, r_start int, r_end int")
    units = spark.createDataFrame([(1, "f", 1, 12), (2, "f", 1, 5), (3, "g", 6, 20)], "unit int, file string, start int, end int")
    assert tuple(census.reachable(gold, units, spark.createDataFrame([(3, 1)], "a int, b int")).first()) == (3, 1, 1)


def test_runs_with_lines_and_marks(spark):
    body = [f"    step({i})" for i in range(9)]
    f = spark.createDataFrame([(1, "a.py", "\n".join(["{", *body, "x"])), (2, "b.py", "\n".join(["y", "", *body[:4], "}", *body[4:]])), (3, "c.py", "\n".join([*body, "# TODO"]))], "k int, p string, s string")
    r = runs.shared_runs(runs.line_windows(f, "k", F.lit("python"), "s"))
    got = {(x.a, x.b): (x.lines, x.a_from, x.a_to, x.b_from, x.b_to) for x in runs.with_lines(r, f, "k", "s").collect()}
    assert got == {(1, 2): (9, 2, 10, 3, 12), (1, 3): (9, 2, 10, 1, 9)}
    mark = runs.marked_lines(f, "k", "s", "step(8)")
    assert runs.without_marked(runs.with_lines(r, f, "k", "s"), mark).count() == 0
    assert runs.without_marked(runs.with_lines(r, f, "k", "s"), runs.marked_lines(f, "k", "s", "TODO")).count() == 2


def test_sources(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "build/b.py": "y\n", "keep/build.py": "z\n", "c.h": "namespace x { }\n", "d.py": "a\0b", "e.py": "\x1b[1ma\x1b[2mb\x1b[3mc", "sub/f.py": "f", "sub/g.py": "g", "docs/r.md": "# R\n", "node_modules/q.md": "q"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / ".gitignore").write_text("# built\nbuild/\n*.log\n")
    (tmp_path / "sub/.gitignore").write_text("*.py\n!g.py\n")
    rel = lambda df: sorted(r.path.split(tmp_path.name + "/")[1] for r in df.collect())
    found = rel(state.discover(spark, [str(tmp_path)]))
    assert [x for x in found if not x.endswith(".md")] == ["a.py", "keep/build.py", "sub/g.py"]
    assert rel(state.discover_prose(spark, [str(tmp_path)])) == ["docs/r.md"]
    feats = spark.createDataFrame([("k1", 3)], "key string, n int")
    state.add_to_cache(feats, str(tmp_path / "cache"), "o1")
    state.add_to_cache(feats.withColumn("key", F.lit("k2")), str(tmp_path / "cache"), "o2")
    assert [r.key for r in state.read_cache(spark, str(tmp_path / "cache"), "o2").collect()] == ["k2"]


def test_generated_header(spark):
    d = spark.createDataFrame([("// Code generated by x\na",), ("a\n" * 9 + "// generated by x",), ("",), (None,)], "s string")
    assert [r[0] for r in d.select(T.generated_header(F.col("s"))).collect()] == [True, False, False, None]


def test_options():
    assert O.parse_mode("exact,near:0.6") == (("exact", None), ("near", 0.6)) and O.parse_mode("near") == (("near", 0.8),)
    for bad in ("nope", "near:x", "near:0", "near:2", "exact:0.5"):
        with pytest.raises(ValueError):
            O.parse_mode(bad)
    with pytest.raises(ValueError):
        O.Options(threshold=2)
    o = O.Options(exclude=("a",)).with_settings({"mode": "near:0.7", "exclude": ["b"], "top": 5})
    assert (o.channels, o.exclude, o.top) == ((("near", 0.7),), ("a", "b"), 5)


def test_channels_combined(spark):
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words)
    near = " ".join([*words[:-2], "x", "y"])
    units = spark.createDataFrame([(1, text), (2, text), (3, near), (4, "else entirely"), (5, None), (6, "")], "id long, norm string")
    got = {(r.a, r.b): (r.channel, r.channels) for r in O.combine(O.detectors(O.Options()), units).collect()}
    assert got == {(1, 2): ("exact", 1), (1, 3): ("near", 1)}


def test_command_line(spark, sf, tmp_path):
    def run(*args):
        out = io.StringIO()
        return main(list(args), spark, out), out.getvalue()

    assert "fam_view" in run("list")[1] and "WITH" in run("sql", "fam_view")[1]
    assert len(run("run", "code_languages", sf, "--rows", "3")[1].splitlines()) == 3
    code, text = run("query", sf, "sort=value", "top=2", "all", "--format", "json")
    assert code == 0 and len(json.loads(text)) == 2
    base = str(tmp_path / "base")
    assert run("query", sf, "--baseline", base, "--write-baseline")[0] == 0
    assert run("query", sf, "top=1", "--baseline", base, "--fail-on", "new")[0] == 0 and run("query", sf, "top=1", "--fail-on", "any")[0] == 1
    assert run("query", sf, "nope=1")[0] == 2 and json.loads(run("query", sf, "top=2", "--format", "sarif")[1])["version"] == "2.1.0"
    assert run("query", sf, "--format", "markdown")[1].startswith("| key |") and "unchanged" in run("query", sf, f"since={base}", "top=1", "all")[1]


def write(spark, path, texts):
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


GUIDE = "# Install\n\nDownload the archive for your platform and unpack it into a folder of your choice.\nThen start the service once so that it writes its settings.\nOpen the settings and enter the address of the server.\n"


def test_equal_sections_are_one_family(spark, tmp_path):
    f = sections.sec_families(spark, write(spark, tmp_path, [GUIDE] * 3 + ["# Other\n\nNothing of this text stands anywhere else in these guides at all.\n"])).collect()
    assert [(r.tier, r.members, r.files, r.is_exact, r.score) for r in f] == [("exact", 3, 3, True, 1.0)]


def test_reworded_and_templated_sections(spark, tmp_path):
    near = GUIDE.replace("platform", "system").replace("once", "first")
    digits = [GUIDE.replace("Install", f"Install {i}") + f"Build {i}{i}{i} is the one that these words belong to.\n" for i in range(8)]
    got = {r.members: r for r in sections.sec_families(spark, write(spark, tmp_path / "a", [GUIDE, near, "# Else\n\nA word on colours and on how they are mixed in the workshop.\n"])).collect()}
    assert set(got) == {2} and not got[2].is_exact and got[2].score > 0.5
    tmpl = sections.sec_families(spark, write(spark, tmp_path / "b", digits)).collect()
    assert [(r.members, r.is_template, r.is_exact) for r in tmpl] == [(8, True, False)]


def test_small_block_in_a_large_section(spark, tmp_path):
    block = "Keep the key in the safe on the second floor.\nAsk the guard for the list before you open it.\nSign the list and lock the safe again afterwards.\n"
    rng = random.Random(2)
    other = lambda n: "\n".join(" ".join(f"{rng.choice('bcdfg')}{rng.randrange(9999)}" for _ in range(9)) for _ in range(n)) + "\n"
    p = sections.sec_pairs(spark, write(spark, tmp_path, [block, other(12) + block + other(12), other(20)])).collect()
    assert [(r.a, r.b) for r in p] == [(0, sections.PLACES)] and p[0].containment >= 0.8


def test_units(spark):
    d = spark.createDataFrame([(1, "intro\n\n# A b\nx\r\n## \ny\n\n"), (2, "no heading\nat all"), (3, ""), (4, None), (5, "\n \n# H\n"), (6, "#no\n")], "doc_id long, text string")
    got = [(r.doc_id, r.unit_no, r.kind, r.heading, r.start_line, r.end_line) for r in PF.sections(d, "doc_id", "text").orderBy("doc_id", "unit_no").collect()]
    assert got == [(1, 0, "Section", None, 1, 2), (1, 1, "Section", "A b", 3, 4), (1, 2, "Section", "", 5, 7), (2, 0, "Document", None, 1, 2), (5, 1, "Section", "H", 3, 3), (6, 0, "Document", None, 1, 1)]


def recall(spark, path, ratio):
    """Reworded copies of distinct sections that are accepted as pairs with them."""
    rng = random.Random(int(ratio * 1000))
    text = [r.norm for r in sections.units(spark, "/root/testdata/sf0.001").orderBy("id").collect()]
    base = list(dict.fromkeys(t for t in text if len(t.split()) >= 25))[:40]
    vocabulary = [w for t in base for w in t.split()]
    made = []
    for t in base:
        ws = t.split()
        for _ in range(round(len(ws) * ratio)):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        made.append(" ".join(ws))
    p, _, _ = sections.Prepared(spark, write(spark, path, base + made)).accepted()
    n = len(base)
    hit = {(r.a // sections.PLACES, r.b // sections.PLACES) for r in p.select("a", "b").collect()}
    return sum(base[i] == made[i] or (i, n + i) in hit for i in range(n)) / n


@pytest.mark.parametrize("ratio, floor", [(0.0, 0.99), (0.1, 0.95), (0.2, 0.85), (0.35, 0.65)])
def test_recall_of_reworded_sections(spark, tmp_path, ratio, floor):
    assert recall(spark, tmp_path, ratio) >= floor


def test_candidates_of_documents_are_measured(spark, sf):
    r = sections.md_candidate_recall(spark, sf).first()
    assert r.by_either <= r.accepted and prose.md_accept_pairs(spark, sf).count() == r.accepted


def test_token_runs(spark):
    body = "\n".join(f"    value{i} = step(value{i}, {i})" for i in range(6))
    renamed = body.replace("value", "other").replace("step", "walk")
    names = "\n".join(f"    name{i}," for i in range(30))
    f = spark.createDataFrame(
        [(1, "a.py", "def f():\n" + body), (2, "b.py", "import x\n\n\nclass A:\n" + renamed + "  # the same\n"), (3, "c.py", body.split("\n")[0]), (4, "d.js", body), (5, "e.py", "X = [\n" + names), (6, "f.py", "y\n" + names), (7, "g.py", None), (8, "h.py", "")], "k int, p string, s string"
    )
    stream = runs.token_stream(f, "k", T.language_of(F.col("p")), "s")
    assert {r.file: (r.tags[:4], r.lines[:4]) for r in stream.collect()}[3] == (["I", "=", "I", "("], [1, 1, 1, 1])
    got = {(r.a, r.b): (r.tokens, r.a_from, r.a_to, r.b_from, r.b_to) for r in runs.token_runs(stream).collect()}
    assert got == {(1, 2): (49, 1, 7, 4, 10)}  # from the colon before on; a list of names is none, and one line is too short


def test_token_runs_go_as_far_as_both_stay_equal(spark):
    rng = random.Random(8)
    lines = [" ".join(rng.choice(runs.WORDS) for _ in range(12)) for _ in range(12)]  # every line has a form of its own
    files = [(i, "p.py", "\n".join(lines[i : i + 3])) for i in range(10)] + [(20, "p.py", "\n".join(lines)), (21, "p.py", "x = 1\n" + "\n".join(lines))]
    stream = runs.token_stream(spark.createDataFrame(files, "k int, p string, s string"), "k", F.lit("python"), "s")
    got = {(r.a, r.b) for r in runs.token_runs(stream, lines=2).collect()}
    assert {(i, 20) for i in range(10)} <= got and {(i, 21) for i in range(10)} <= got


def test_block_likeness_against_all_pairs(spark):
    """Over the bounds of blocks, each set once or twice and never once per pair."""
    rng = random.Random(5)
    pool = [[rng.choice("ab") for _ in range(rng.randrange(1, 14))] for _ in range(30)]
    cut = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    sets = [(i, rng.choice(pool), rng.choice(["x", "y", None])) for i in range(100)]
    want = []
    for i, g, s in sets:
        for _, h, t in sets[i + 1 : i + 8]:
            j = len(cut(g) & cut(h)) / len(cut(g) | cut(h))
            if j >= 0.5:
                want.append((round(j, 9), s == t))
    placed = census.blocks(spark.createDataFrame(sets, "i long, w array<string>, source string"), 7, 16)
    assert placed.count() == 100 + 6 * 7 - 3  # the last block has four
    assert sorted((round(r.jaccard, 9), r.same) for r in census.block_likeness(placed, 0.5, 7, 16).collect()) == sorted(want)
