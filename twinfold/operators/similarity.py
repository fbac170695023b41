"""Similarity joins over texts: classes of equal texts, exact set-similarity join
with prefix filtering, MinHash with banding, winnowing, and pair scores.

Equal texts are one class and only class representatives are joined, so a group
of a million copies costs one row. A class keeps its members in `classes`; no link
between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .scale import cut, lookup, spread

#: Signature length and rows per band; a bucket above BUCKET is not expanded into all pairs.
PERMS, ROWS, BUCKET = 128, 4, 48
#: Modulus of the hash family: products stay within 64 bits.
PRIME = 2147483647


def hash60(c: Column) -> Column:
    """The first 60 bits of the md5 as a BIGINT, the same number everywhere."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")


def classes(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(id, class_id): documents with a text that is not blank; equal normalised
    texts share the smallest id as class. Texts are compared by their SHA-256, so
    no text is shuffled."""
    one = spread(docs.select(F.col(key).alias("id"), text.alias("norm")))
    one = cut(one.filter("norm IS NOT NULL AND norm <> ''").select("id", F.sha2("norm", 256).alias("h")))
    low = one.groupBy("h").agg(F.min("id").alias("class_id"))
    return lookup(one, low, "h").select("id", "class_id")


def representatives(cls: DataFrame, docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(class_id, norm): the normalised text of one document per class."""
    first = cls.filter("id = class_id").select("class_id").distinct()
    return docs.select(F.col(key).alias("class_id"), text.alias("norm")).join(first, "class_id", "left_semi")


def word_shingles(reps: DataFrame, n: int = 5, quick: bool = False) -> DataFrame:
    """(class_id, size, grams): sorted hashes of the distinct n-word shingles; `quick`
    ones where only equality counts, else `hash60`."""
    w = T.words(F.col("norm"))
    if quick:  # the words of a window are hashed as they are
        reps = reps.select("class_id", w.alias("w"))
        win = F.transform(T.windows(F.col("w"), n), lambda s: F.xxhash64(*(s[f"x{i}"] for i in range(n))))
        grams = F.when(F.size("w") == 0, F.array().cast("array<bigint>")).when(F.size("w") < n, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(win)
    else:
        grams = F.transform(T.shingles(w, n), hash60)
    return cut(reps.select("class_id", F.sort_array(F.array_distinct(grams)).alias("grams"))).withColumn("size", F.size("grams")).filter("size > 0")


def low_shingles(docs: DataFrame, n: int = 5) -> DataFrame:
    """(id, h, g) of (id, h, w ARRAY<STRING>): the lowest `hash60` of the n-word
    shingles of the words `w`; rows without words are left out."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        for b in batches:
            low = [min((md5(s).digest() for s in shingles_of(w, n)), default=None) for w in (x.as_py() for x in b.column(2))]
            g = pa.array([None if x is None else int.from_bytes(x[:8]) >> 4 for x in low], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), g], names=["id", "h", "g"])

    return docs.select("id", "h", "w").mapInArrow(run, f"id {kind}, h string, g bigint").filter("g IS NOT NULL")


def shingles_of(w: list[str], n: int = 5) -> set[bytes]:
    """The distinct n-word shingles of a list of words, as `text.shingles` has them."""
    if len(w) < n:
        return {" ".join(w).encode()} if w else set()
    return {" ".join(w[i : i + n]).encode() for i in range(len(w) - n + 1)}


def jaccard_links(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, shared, jaccard) with a < b for every pair of `sets` (class_id, size,
    grams) of at least `threshold`: exact.

    Prefix filtering: two sets of Jaccard t share one of the rarest
    size - ceil(t * size) + 1 elements of each, in any common order; by rarity the
    posting lists stay short. The sizes of a pair must be within t of each other.
    Only ids and hashes of the prefixes are shuffled for the join; whole sets are
    joined back to the surviving pairs."""
    df = sets.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    long = sets.select("class_id", "size", F.explode("grams").alias("g"))
    placed = lookup(long, df, "g").groupBy("class_id", "size").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o"))
    keep = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - 1e-9) + 1
    prefix = placed.select("class_id", "size", F.posexplode(F.slice("o", F.lit(1), keep.cast("int"))).alias("pos", "e")).select("class_id", "size",
        "pos", F.col("e.g").alias("g"), F.col("e.df").alias("df"))
    prefix = cut(prefix.filter("df > 1"))  # an element of one set joins nothing
    l, r = prefix.alias("l"), prefix.alias("r")
    near = (F.col("l.size") >= F.col("r.size") * threshold - 1e-9) & (F.col("r.size") >= F.col("l.size") * threshold - 1e-9)
    # positional filter: what can still follow the shared element on both sides must suffice
    rest = 1 + F.least(F.col("l.size") - F.col("l.pos") - 1, F.col("r.size") - F.col("r.pos") - 1) + F.least("l.pos", "r.pos")
    need = (F.col("l.size") + F.col("r.size")) * (threshold / (1 + threshold)) - 1e-9
    pairs = l.join(r, (F.col("l.g") == F.col("r.g")) & (F.col("l.class_id") < F.col("r.class_id")) & near & (rest >= need))
    pairs = pairs.select(F.col("l.class_id").alias("a"), F.col("r.class_id").alias("b")).distinct()
    return score_pairs(pairs, sets).filter(F.col("jaccard") >= threshold - 1e-12).select("a", "b", "shared", "jaccard")


def score_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard, containment) from whole sets."""
    side = lambda n: sets.select(F.col("class_id").alias(n), F.col("grams").alias(f"g{n}"), F.col("size").alias(f"n{n}"))
    j = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    j = j.withColumn("shared", F.size(F.array_intersect("ga", "gb")))
    jac = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return j.select("a", "b", "shared", jac.alias("jaccard"), (F.col("shared") / F.least("na", "nb")).alias("containment"))


def per_document(cls: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, n_copies, n_links): one row per document; n_links counts the
    linked classes."""
    ends = links.select(F.col("a").alias("class_id")).unionByName(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    size = cls.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_copies"))
    each = size.join(ends, "class_id", "left").select("class_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    return lookup(cls.select("id", "class_id"), each, "class_id").select("id", "class_id", "n_copies", "n_links")


def permutations(k: int = PERMS) -> list[tuple[int, int]]:
    """(a, b) of the hash family from a linear congruential rule."""
    out, s = [], 12345
    for _ in range(k):
        s = (s * 1103515245 + 12345) % (1 << 31)
        a = s % (PRIME - 1) + 1
        s = (s * 1103515245 + 12345) % (1 << 31)
        out.append((a, s % PRIME))
    return out


def signatures(sets: DataFrame, k: int = PERMS) -> DataFrame:
    """(class_id, sig ARRAY<BIGINT>): minima of (a * h + b) mod PRIME."""
    kind = dict(sets.dtypes)["class_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ab = np.asarray(permutations(k), np.int64)
        for b in batches:
            out = np.empty((b.num_rows, k), np.int64)
            col = b.column(1)
            off, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False) % PRIME
            for i in range(b.num_rows):
                h = flat[off[i] : off[i + 1]]
                out[i] = ((ab[:, :1] * h[None, :] + ab[:, 1:]) % PRIME).min(axis=1)
            offsets = pa.array(np.arange(0, (b.num_rows + 1) * k, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["class_id", "sig"])

    return sets.select("class_id", "grams").mapInArrow(run, f"class_id {kind}, sig array<bigint>")


def bands(sigs: DataFrame, rows: int = ROWS, k: int = PERMS) -> DataFrame:
    """(class_id, band, key): one row per band."""
    b = F.transform(F.sequence(F.lit(0), F.lit(k // rows - 1)),
        lambda i: F.array_join(F.transform(F.slice(F.col("sig"), i * rows + 1, rows), lambda x: x.cast("string")), ","))
    return sigs.select("class_id", F.posexplode(b).alias("band", "key"))


def bucket_pairs(items: DataFrame, keys: list[str], member: str, most: int = BUCKET) -> DataFrame:
    """(a, b) with a < b, distinct: all pairs of a bucket up to `most` members; a
    larger bucket gives a star around its smallest member and a chain through its
    members, which links all of it with two rows per member. Chains of very large
    buckets run inside pieces, so no task holds a whole bucket."""
    items = items.select(*keys, F.col(member).alias("m")).distinct()
    stat = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first")).filter("n > 1")
    j = items.join(stat, keys)
    small = j.filter(F.col("n") <= most)
    l, r = small.alias("l"), small.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l.m") < F.col("r.m")]
    pairs = l.join(r, on).select(F.col("l.m").alias("a"), F.col("r.m").alias("b"))
    large = j.filter(F.col("n") > most)
    star = large.filter("m > first").select(F.col("first").alias("a"), F.col("m").alias("b"))
    piece = F.pmod(F.xxhash64("m"), F.ceil(F.col("n") / 100_000))
    w = Window.partitionBy(*keys, "piece").orderBy("m")
    chain = large.withColumn("piece", piece).select(F.lag("m").over(w).alias("a"), F.col("m").alias("b")).filter("a IS NOT NULL")
    return pairs.unionByName(star).unionByName(chain).distinct()


def estimate(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b, estimate): share of equal signature places."""
    side = lambda n: sigs.select(F.col("class_id").alias(n), F.col("sig").alias(f"s{n}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return j.select("a", "b", (same / F.size("sa")).alias("estimate"))


def winnow(reps: DataFrame, k: int = 5, w: int = 4) -> DataFrame:
    """(class_id, fps): distinct minima of w hashes of k-character windows in a row."""
    h = F.transform(T.char_ngrams(F.col("norm"), k), hash60)
    low = F.transform(T.windows(F.col("h"), w), lambda s: F.least(*(s[f"x{i}"] for i in range(w))))
    n = F.size("h")
    mins = F.when(n == 0, F.array().cast("array<bigint>")).when(n < w, F.array(F.array_min("h"))).otherwise(low)
    hashed = cut(reps.select("class_id", h.alias("h")))  # or every slice would hash the text again
    return hashed.select("class_id", F.sort_array(F.array_distinct(mins)).alias("fps"))


def shared_rare(sets: DataFrame, column: str, least: int, stop_df: int) -> DataFrame:
    """(a, b, shared): pairs that share at least `least` elements of `column` held
    by at most `stop_df` sets."""
    long = sets.select("class_id", F.explode(column).alias("g"))
    df = long.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(2, stop_df))
    rare = long.join(df, "g")
    l, r = rare.alias("l"), rare.alias("r")
    p = l.join(r, (F.col("l.g") == F.col("r.g")) & (F.col("l.class_id") < F.col("r.class_id")))
    return p.groupBy(F.col("l.class_id").alias("a"), F.col("r.class_id").alias("b")).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def idf_table(sets: DataFrame) -> DataFrame:
    """(g, df, n, idf) with idf = ln((n - df + 0.5) / (df + 0.5) + 1)."""
    n = sets.agg(F.count(F.lit(1)).alias("n"))
    df = sets.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))  # n is one row


def weighted(sets: DataFrame) -> tuple[DataFrame, int]:
    """((class_id, size, grams, dfs, norm), n): of each set the elements that another
    of all `n` holds too, with how many hold them, and the length of the whole tf-idf
    vector. Elements of one set alone, the great majority, are counted in `size` and
    `norm` only; sets without others have no row. A set with `copies` counts so many
    times."""
    copies = F.col("copies") if "copies" in sets.columns else F.lit(1).cast("bigint")
    df = sets.select(copies.alias("c"), F.explode("grams").alias("g")).groupBy("g").agg(F.sum("c").alias("df")).filter("df > 1")
    n = sets.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    idf = lambda d: F.log((n - d + 0.5) / (d + 0.5) + 1)
    long = lookup(sets.select("class_id", F.size("grams").alias("size"), F.explode("grams").alias("g")), df, "g").select("class_id", "size", "g",
        F.col("df").cast("int").alias("df"))
    g = long.groupBy("class_id", "size").agg(F.sort_array(F.collect_list(F.struct("g", "df"))).alias("x"), F.sum(idf(F.col("df")) * idf(F.col("df"))).alias("w"))
    alone = (F.col("size") - F.size("x")) * F.pow(idf(F.lit(1)), 2)
    return g.select("class_id", "size", F.col("x.g").alias("grams"), F.col("x.df").alias("dfs"), F.sqrt(F.col("w") + alone).alias("norm")), n


def pair_stats(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """(a, b, shared, jaccard, containment, cosine, commonness, small_in_large) of
    pairs of `weighted` sets, of which there are `n`: all figures in one pass over the
    two arrays. commonness is the mean share of the sets that hold a shared element."""
    side = lambda k: sets.select(F.col("class_id").alias(k), F.col("grams").alias(f"g{k}"), F.col("norm").alias(f"l{k}"), F.col("size").alias(f"n{k}"))
    other = sets.select(F.col("class_id").alias("b"), F.col("grams").alias("gb"), F.col("norm").alias("lb"), F.col("size").alias("nb"), F.col("dfs").alias("db"))
    j = pairs.select("a", "b").join(side("a"), "a").join(other, "b").select("a", "b", "ga", "la", "gb", "lb", "db", "na", "nb")
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            figures = np.zeros((m, 4))
            counts = np.zeros(m, np.int32)
            cols = [batch.column(k) for k in (2, 4, 6)]
            flat = [c.values.to_numpy(zero_copy_only=False) for c in cols]
            offs = [c.offsets.to_numpy() for c in cols]
            la, lb = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            na, nb = batch.column(7).to_numpy(), batch.column(8).to_numpy()
            small = np.zeros(m, bool)
            for i in range(m):
                x, y, d = (f[o[i] : o[i + 1]] for f, o in zip(flat, offs))
                at = np.searchsorted(x, y)
                hit = np.zeros(len(y), bool)
                ok = at < len(x)
                hit[ok] = x[at[ok]] == y[ok]
                df = d[hit].astype(float)
                k = len(df)
                counts[i] = k
                w = np.log((n - df + 0.5) / (df + 0.5) + 1)
                least, most = sorted((int(na[i]), int(nb[i])))
                figures[i] = (k / (least + most - k), k / least, float((w * w).sum()) / (la[i] * lb[i]) if la[i] * lb[i] else 0.0, float(df.mean()) / n if k else 0.0)
                small[i] = 2 * least < most and figures[i, 1] >= 0.8 and figures[i, 1] > figures[i, 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), *(pa.array(figures[:, k]) for k in range(4)),
                pa.array(small)], names=["a", "b", "shared", "jaccard", "containment", "cosine", "commonness", "small_in_large"])

    return j.mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, shared int, jaccard double, containment double, cosine double, commonness double, small_in_large boolean")


def accept(cosine: Column, containment: Column, shared: Column, least_score: float = 0.5, least_shared: int = 24) -> tuple[Column, Column]:
    """(score, whether the pair is accepted): containment counts where it is high
    and above the cosine."""
    score = F.when((containment >= 0.8) & (containment > cosine), containment).otherwise(cosine)
    return score, (score >= least_score) & (shared >= least_shared)


def with_block(pairs: DataFrame, texts: DataFrame, least_lines: int = 2) -> DataFrame:
    """`pairs` without those of a small text in a large one that have no block of
    equal lines in common: words alone may be contained by chance. `texts` has
    (class_id, lines), the normalised lines that are not blank; only the texts of
    such pairs are joined."""
    from .align import line_witness

    small = pairs.filter("small_in_large")
    side = lambda k: texts.select(F.col("class_id").alias(k), F.array_join("lines", "\n").alias(f"{k}_text"))
    seen = line_witness(small.select("a", "b").join(side("a"), "a").join(side("b"), "b")).filter(F.col("matched") >= least_lines).select("a", "b")
    return pairs.filter("NOT small_in_large").unionByName(small.join(seen, ["a", "b"], "left_semi"))


def char_sets(reps: DataFrame) -> DataFrame:
    """(class_id, size, grams): sorted hashes of the distinct grams of 3 or 5
    characters, by the script of the text, of (class_id, norm)."""
    n3, n5 = T.char_ngrams(F.col("norm"), 3), T.char_ngrams(F.col("norm"), 5)
    grams = F.when(T.gram_size(F.col("norm")) == 3, n3).otherwise(n5)
    hashed = F.sort_array(F.array_distinct(F.transform(grams, hash60)))
    return cut(reps.select("class_id", hashed.alias("grams"))).withColumn("size", F.size("grams")).filter("size > 0")


def candidates(sets: DataFrame, fps: DataFrame, stop_df: int, least: int = 3) -> DataFrame:
    """(a, b) distinct: pairs of a MinHash band, and pairs that share `least`
    winnowing fingerprints of (class_id, fps) held by at most `stop_df` texts."""
    near = bucket_pairs(bands(signatures(sets)), ["band", "key"], "class_id")
    return near.unionByName(shared_rare(fps, "fps", least, stop_df).select("a", "b")).distinct()


def accept_candidates(sets: DataFrame, n: int, least_score: float = 0.5, contained: float = 0.8, least_shared: int = 24) -> DataFrame:
    """(a, b) with a < b, distinct: every pair of `weighted` sets, of which there are
    `n`, that `accept` can take, by either rule.

    With the elements of each set ordered by rarity, take the first one a pair
    shares. Cosine: what follows it holds the whole dot product, so on both sides
    it must hold `least_score` of the norm (Cauchy-Schwarz). Containment: in the
    smaller set it must leave `contained` of the size; it may stand anywhere in
    the larger one. In both, `least_shared` elements must still follow. What follows
    each element is counted inside its row; only elements that can be the first
    shared one of some pair are shuffled."""
    kind = dict(sets.dtypes)["class_id"]
    least_mass = least_score * least_score - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, dfs = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column(1), batch.column(2)))
            norms, sizes = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            owner, g_out, left_out, mass_out, size_out = [], [], [], [], []
            for i in range(batch.num_rows):
                g, d = grams[0][grams[1][i] : grams[1][i + 1]], dfs[0][dfs[1][i] : dfs[1][i + 1]].astype(float)
                size = int(sizes[i])
                if len(g) < least_shared:
                    continue
                order = np.lexsort((g, d))[::-1]  # the most common first
                g, d = g[order], d[order]
                w = np.log((n - d + 0.5) / (d + 0.5) + 1)
                left, mass = np.arange(1, len(g) + 1), np.cumsum(w * w) / (norms[i] * norms[i])
                keep = left >= least_shared
                k = int(keep.sum())
                owner.append(np.full(k, i))
                g_out.append(g[keep])
                left_out.append(left[keep])
                mass_out.append(mass[keep])
                size_out.append(np.full(k, size))
            cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
            ids = batch.column(0).take(pa.array(cat(owner, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cat(size_out, np.int32)), pa.array(cat(g_out, np.int64)),
                pa.array(cat(left_out, np.int32)), pa.array(cat(mass_out, np.float64))], names=["class_id", "size", "g", "left", "mass"])

    placed = cut(sets.select("class_id", "grams", "dfs", "norm", "size").mapInArrow(run, f"class_id {kind}, size int, g bigint, left int, mass double"))
    on = (F.col("l.g") == F.col("r.g")) & (F.col("l.class_id") != F.col("r.class_id"))
    ends = [F.least("l.class_id", "r.class_id").alias("a"), F.greatest("l.class_id", "r.class_id").alias("b")]
    heavy = placed.filter(F.col("mass") >= least_mass)
    alike = heavy.alias("l").join(heavy.alias("r"), on & (F.col("l.class_id") < F.col("r.class_id")) & (F.col("l.mass") * F.col("r.mass") >= least_mass)).select(*ends)
    need = F.col("size") * contained - 1e-9
    small = placed.filter(F.col("left") >= need).withColumn("need", need)
    inside = small.alias("l").join(placed.alias("r"), on & (F.col("l.size") <= F.col("r.size")) & (F.col("r.left") >= F.col("l.need"))).select(*ends)
    return alike.unionByName(inside).distinct()


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of two arrays with repetitions; two empty
    arrays give 1. The k-th repetition of a value is made a value of its own."""
    tag = lambda xs: F.transform(F.array_sort(xs), lambda x, i: F.struct(x.alias("x"), (i - F.array_position(F.array_sort(xs), x)).alias("k")))
    inter = F.size(F.array_intersect(tag(a), tag(b)))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(inter / (F.size(a) + F.size(b) - inter))
