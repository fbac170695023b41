"""Results are whole: cases that candidate caps and narrow reads used to lose."""

import random

from pyspark.sql import functions as F

from twinfold.operators import code
from twinfold.operators import similarity as S
from twinfold.plans import prose


def documents(spark, path, texts):
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def sentence(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def in_lines(words, n=10):
    return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))


def test_accepts_small_in_large(spark, tmp_path):
    rng = random.Random(1)
    texts = []
    for _ in range(8):  # Jaccard about 0.07, containment 1
        short = sentence(rng, 60)
        texts += [in_lines(short), in_lines(sentence(rng, 400) + short + sentence(rng, 400))]
    for _ in range(4):  # the same words, but no block of lines in common
        short = sentence(rng, 60)
        texts += [in_lines(short), in_lines(sentence(rng, 403) + short + sentence(rng, 400))]
    got = {(r.a, r.b) for r in prose.md_accept_pairs(spark, documents(spark, tmp_path, texts)).collect()}
    assert got == {(i, i + 1) for i in range(0, 16, 2)}


def test_accepted_are_those_of_all_pairs(spark, tmp_path):
    rng = random.Random(2)
    base = [sentence(rng, rng.choice((60, 120, 300))) for _ in range(6)]
    texts = []
    for _ in range(60):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            x[rng.randrange(len(x))] = f"v{rng.randrange(100_000)}"
        texts.append(in_lines(x[: rng.randrange(len(x) // 2, len(x) + 1)] + sentence(rng, rng.choice((0, 20, 200)))))
    d = documents(spark, tmp_path, texts)
    _, sets = prose.sets_of(spark, d)
    every = sets.alias("l").join(sets.alias("r"), F.col("l.class_id") < F.col("r.class_id")).select(F.col("l.class_id").alias("a"), F.col("r.class_id").alias("b"))
    j = S.pair_stats(every, *S.weighted(sets))
    want = {(r.a, r.b) for r in S.with_block(j.filter(S.accept(F.col("cosine"), F.col("containment"), F.col("shared"))[1]), prose.lines_of(spark, d)).collect()}
    assert len(want) > 50
    assert {(r.a, r.b) for r in prose.md_accept_pairs(spark, d).collect()} == want


def test_near_clones_beyond_a_bucket(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        shapes = sorted([1] * 30 + list(range(2, 60)) + [1000 + rng.randrange(40) for _ in range(10)])
        rows.append((f"t{i:02}", i, "p", 1, 50, 200, shapes))
    u = spark.createDataFrame(rows, "tree string, file_id long, path string, start_line int, end_line int, tokens int, shapes array<bigint>")
    assert code.near_clones(u).count() == 60 * 59 // 2  # all alike by 88 of 108 at least


def test_near_clones_of_one_multiset_are_tied_to_the_first(spark):
    rows = [(f"t{i}", i, "p", 1, 50, 200, list(range(40))) for i in range(30)] + [("u", 99, "p", 1, 50, 200, list(range(2, 42)))]
    u = spark.createDataFrame(rows, "tree string, file_id long, path string, start_line int, end_line int, tokens int, shapes array<bigint>")
    got = {(r.a, r.b): r.score for r in code.near_clones(u).collect()}
    assert got == {**{("t0", f"t{i}"): 1.0 for i in range(1, 30)}, ("t0", "u"): round(38 / 42, 3)}
