"""Packed sets and rounds give the pairs that whole sets sent with every candidate give."""

import random

import numpy as np
import pytest

from twinfold.operators import gram_sets as GS
from twinfold.operators import similarity as S
from twinfold.plans import sections
from pyspark.sql import functions as F


def write(spark, path, texts):
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def texts():
    """Small changes to a few texts, 60 texts of one bucket, another script, and copies."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randrange(2, 8)))
    words = [word() for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randrange(30, 90))] for _ in range(25)]
    out = [" ".join(w) for w in base]
    for w in base * 2:
        w = list(w)
        for _ in range(len(w) // 5):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [" ".join([*base[0], words[i]]) for i in range(60)]  # one bucket above BUCKET in most bands
    han = [chr(0x4E00 + i) for i in range(400)]
    line = ["".join(rng.choice(han) for _ in range(6)) for _ in range(40)]
    out += [" ".join(line[i : i + 20]) for i in range(0, 20, 4)] + [" ".join(["\U0001f600"] * 3 + base[1])]
    return out + out[:4]


def by_whole_sets(x, n):
    """The pairs as they were found before: both whole sets beside each candidate."""
    norms = GS.text_of(x.reps, "class_id", "norm")
    copies = x.reps.select("class_id", "copies")
    sets, total = S.weighted(S.char_sets(norms).join(copies, "class_id"))
    assert total == n
    score, ok = S.accept(F.col("cosine"), F.col("containment"), F.col("shared"))
    j = S.pair_stats(x.candidates(), sets, n).withColumn("score", score)
    return S.with_block(j.filter(ok), x.lines(j))


@pytest.mark.parametrize("batch, block, bytes_, share", [(1500, 2_000_000, 64_000_000, 1.0), (40, 2_500, 60_000, 0.5)])
def test_pairs_against_whole_sets(spark, tmp_path, monkeypatch, batch, block, bytes_, share):
    for name, v in (("BATCH", batch), ("BLOCK", block), ("LEAST_ROUND", bytes_), ("SHARE", share)):
        monkeypatch.setattr(GS, name, v)
    x = sections.Prepared(spark, write(spark, tmp_path, texts()))
    want = {(r.a, r.b): r for r in by_whole_sets(x, x.classes.count()).collect()}
    got = x.accepted()[0].collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} == set(want) and len(want) > 100
    for r in got:
        for c in ("shared", "jaccard", "containment", "cosine", "commonness", "score", "small_in_large"):
            assert r[c] == pytest.approx(want[r.a, r.b][c], abs=1e-9)


def test_sets_are_not_sent_with_every_candidate(spark, tmp_path, monkeypatch):
    """At any time there is one copy of the sets a round, however many candidates there are."""
    monkeypatch.setattr(S, "pair_stats", lambda *a: pytest.fail("whole sets beside every pair"))
    pairs, _, _ = sections.Prepared(spark, write(spark, tmp_path, texts())).accepted()
    assert pairs.count() > 100


def test_packed_sets_and_windows():
    rng = np.random.default_rng(1)
    for top in (10, 70_000, 5_000_000):
        ids = np.unique(rng.integers(0, top, 300))
        e = GS.encoded(ids)
        assert GS.decoded(e).tolist() == ids.tolist()
        codec = GS.pa.Codec("zstd", 1)
        assert GS.expanded(codec, GS.compressed(codec, e), len(e)).tolist() == e.tolist()
    assert len(GS.decoded(GS.encoded(np.zeros(0, np.int64)))) == 0
    many = "".join(chr(0x3400 + i % 20_000) for i in range(30_000)) + "\U0001f600 end"  # more signs than fit beside each other
    for k in (3, 5):
        ids, off, h = GS.windows([many, "abcdefgh", many[::-1]], k)
        for j, t in enumerate((many, "abcdefgh", many[::-1])):
            got = h[ids[off[j] : off[j + 1]]]
            want = [int(GS.md5(t[i : i + k].encode()).hexdigest()[:15], 16) for i in range(len(t) - k + 1)]
            assert got.tolist() == want
