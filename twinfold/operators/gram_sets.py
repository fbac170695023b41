"""Near copies among texts by the grams of their characters, with little on disk:
texts and sets are kept compressed, grams as numbers by rarity, and sets meet in the
buckets of their candidates in rounds, of which only one is on disk at a time.

The grams, signatures, fingerprints and figures are those of `similarity`; texts have
eight words or more, so none is shorter than a gram or a window of fingerprints."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from functools import reduce
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scale import cut, cut_counted, release
from .similarity import BUCKET, PERMS, PRIME, ROWS, permutations

#: Texts handled at once, and grams and fingerprints whose counts are sent to all tasks at once.
BATCH, BLOCK = 1500, 2_000_000
#: A round moves this many times the bytes of all sets, or LEAST_ROUND bytes.
SHARE, LEAST_ROUND = 1.0, 64_000_000
#: Sets are written in so many parts, which are deleted one by one as they are placed.
PARTS = 4
#: Buckets above PIECE members are cut into pieces, each with the bucket's first member.
PIECE = 100_000
#: In a packed set, STEP says that no element ends here and the distance goes on.
STEP = 65535


def pack(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with the text compressed into `z`; `n1` are its bytes, `h` is its SHA-256
    and `words` the number of its words."""
    rest = [c for c in docs.columns if c != text]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for b in batches:
            texts = [s or "" for s in b.column(text).to_pylist()]
            words = pa.array([sum(w != "" for w in s.split(" ")) for s in texts], pa.int32())
            x = [s.encode() for s in texts]
            z = pa.array([codec.compress(s, asbytes=True) for s in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), z, pa.array(map(len, x), pa.int32()),
                pa.array([sha256(s).hexdigest() for s in x], pa.string()), words], names=[*rest, "z", "n1", "h", "words"])

    return docs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in rest) + ", z binary, n1 int, h string, words int")


def unpack(b: pa.RecordBatch) -> list[str]:
    codec = pa.Codec("zstd")
    return [codec.decompress(z, n, asbytes=True).decode() for z, n in zip(b.column("z").to_pylist(), b.column("n1").to_pylist())]


def text_of(packed: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(unpack(b), pa.string())], names=[key, name])

    return packed.select(key, "z", "n1").mapInArrow(run, f"{key} {dict(packed.dtypes)[key]}, {name} string")


def windows(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, hashes): the windows of k characters of each text in their order
    as numbers into `hashes`, which holds the `hash60` of each distinct window once."""
    size = np.array([len(t) for t in texts], np.int64)
    whole = "".join(texts)
    flat = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    start = np.cumsum(size) - size
    count = size - k + 1
    offsets = np.r_[0, np.cumsum(count)]
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], count)
    seen = np.zeros(0x110000, bool)
    seen[flat] = True
    rank = (np.cumsum(seen) - 1)[flat]
    bits = max(1, int(seen.sum() - 1).bit_length())
    key, used = rank[at], bits
    for i in range(1, k):
        if used + bits > 62:  # numbers instead of characters make room again
            key = pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64)
            used = max(1, int(key.max()).bit_length())
        key, used = key << bits | rank[at + i], used + bits
    d = pa.array(key).dictionary_encode()
    ids = d.indices.to_numpy()
    place = np.empty(len(d.dictionary), np.int64)
    place[ids] = at
    raw = b"".join([md5(whole[p : p + k].encode()).digest()[:8] for p in place.tolist()])
    return ids, offsets, (np.frombuffer(raw, ">u8") >> np.uint64(4)).astype(np.int64)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple], tuple]]:
    """Batches of (class_id, copies, k, z, n1) with the windows of their grams, for
    each size of a gram (rows, ids, offsets, hashes), and those of five characters of all."""
    for big in batches:
        for i in range(0, big.num_rows, BATCH):
            b = big.slice(i, BATCH)
            texts, k = unpack(b), b.column("k").to_numpy()
            five = windows(texts, 5)
            if (k == 5).all():
                yield b, [(np.arange(b.num_rows), *five)], five
                continue
            ids, off, h = five
            ones, threes = np.flatnonzero(k == 5), np.flatnonzero(k == 3)
            at = np.concatenate([ids[off[r] : off[r + 1]] for r in ones]) if len(ones) else ids[:0]
            yield b, [(ones, at, np.r_[0, np.cumsum(np.diff(off)[ones])], h), (threes, *windows([texts[r] for r in threes], 3))], five


def prints(five: tuple) -> list[np.ndarray]:
    """Of each text the distinct minima of four hashes in a row, sorted."""
    ids, off, h = five
    x = h[ids]
    low = np.minimum(np.minimum(x[:-3], x[1:-2]), np.minimum(x[2:-1], x[3:]))
    return [np.unique(low[off[i] : off[i + 1] - 3]) for i in range(len(off) - 1)]


def counts(reps: DataFrame, most: int) -> DataFrame:
    """(kind, g, df): kind 0 the grams that several texts hold, where one with `copies`
    counts so often; kind 1 the fingerprints of 2 to `most` classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, groups, five in parts(batches):
            copies = b.column("copies").to_numpy()
            fps, n = np.unique(np.concatenate(prints(five)), return_counts=True)
            gs, cs = [], []
            for rows, ids, off, h in groups:
                c = np.zeros(len(h), np.int64)
                for j, r in enumerate(rows):
                    c[np.unique(ids[off[j] : off[j + 1]])] += copies[r]
                held = c > 0
                gs.append(h[held])
                cs.append(c[held])
            g = np.concatenate([*gs, fps])
            kind = np.r_[np.zeros(len(g) - len(fps), np.int8), np.ones(len(fps), np.int8)]
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(g), pa.array(np.concatenate([*cs, n]))], names=["kind", "g", "c"])

    long = reps.mapInArrow(run, "kind tinyint, g bigint, c bigint")
    return long.groupBy("kind", "g").agg(F.sum("c").alias("df")).filter((F.col("df") > 1) & ((F.col("kind") == 0) | (F.col("df") <= most)))


def encoded(ids: np.ndarray) -> np.ndarray:
    """Sorted numbers as distances in 16 bits."""
    step = np.diff(ids, prepend=0)
    more = step // STEP
    out = np.full(len(ids) + int(more.sum()), STEP, np.uint16)
    out[np.cumsum(more + 1) - 1] = step % STEP
    return out


def decoded(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.int64)[x != STEP]


def compressed(codec: pa.Codec, x: np.ndarray) -> bytes:
    return codec.compress(x.view(np.uint8).reshape(-1, 2).T.tobytes(), asbytes=True) if len(x) else b""


def expanded(codec: pa.Codec, z: bytes, n: int) -> np.ndarray:
    return np.frombuffer(codec.decompress(z, 2 * n, asbytes=True), np.uint8).reshape(2, n).T.copy().view(np.uint16).ravel() if n else np.zeros(0, np.uint16)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each band and its rows of the signatures."""
    h = np.broadcast_to(np.arange(1, PERMS // ROWS + 1, dtype=np.uint64), (len(sig), PERMS // ROWS))
    for i in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, i::ROWS].astype(np.uint64))
    return h.astype(np.int64)


def block_of(found: DataFrame, i: int, blocks: int, base: int, n: int) -> tuple:
    """Grams and rare fingerprints of a block: (sorted hashes, their numbers, their
    counts, sorted rare fingerprints, counts by number). Common grams have low numbers."""
    t = found.filter(F.pmod("g", F.lit(blocks)) == i).select("kind", "g", "df").toArrow()
    kind, g, df = (t.column(c).to_numpy() for c in ("kind", "g", "df"))
    rare = np.sort(g[kind == 1])
    g, df = g[kind == 0], df[kind == 0]
    order = np.lexsort((g, -df))
    number = np.empty(len(g), np.int64)
    number[order] = np.arange(base, base + len(g))
    s = np.argsort(g)
    return g[s], number[s], df[s], rare, df[order]


def sets_of(reps: DataFrame, found: DataFrame, n: int) -> tuple[list[DataFrame], np.ndarray]:
    """((class_id, copies, size, mass, own, n_set, packed, bands, fps) in parts, counts by
    number): the sets of the texts as numbers of the grams that several texts hold, of
    all `n`. Counts go to the tasks in blocks of about BLOCK, one at a time; a later
    block adds to the sets of the earlier ones."""
    kind = dict(reps.dtypes)["class_id"]
    blocks = max(1, -(-found.count() // BLOCK))
    sc = reps.sparkSession.sparkContext
    schema = f"class_id {kind}, copies bigint, k int, z binary, n1 int, size int, mass double, own double, n_set int, packed binary, bands array<bigint>, fps array<bigint>"
    by_number: list[np.ndarray] = []
    out = [reps.filter(F.pmod(F.xxhash64("class_id"), F.lit(PARTS)) == p) for p in range(PARTS)]
    for i in range(blocks):
        last = i == blocks - 1
        *head, dfs = block_of(found, i, blocks, sum(map(len, by_number)), n)
        by_number.append(dfs)
        told = sc.broadcast(head)

        def run(batches: Iterator[pa.RecordBatch], i: int = i, last: bool = last, told=told) -> Iterator[pa.RecordBatch]:
            known, number, held, rare = told.value
            codec, ab = pa.Codec("zstd", 1), np.asarray(permutations(), np.int64)
            place = lambda h, of: np.minimum(np.searchsorted(of, h), max(0, len(of) - 1))
            within = lambda h, of: of[place(h, of)] == h if len(of) else np.zeros(len(h), bool)
            for b, groups, five in parts(batches):
                m = b.num_rows
                old = lambda c, d: b.column(c).to_pylist() if i else [d] * m  # noqa: E731, B023
                size, mass, own, packed, n_set = np.zeros(m, np.int32), np.array(old("mass", 0.0)), np.array(old("own", 0.0)), old("packed", b""), old("n_set", 0)
                sig = np.empty((m, PERMS), np.int32)
                for rows, ids, off, h in groups:
                    if not i:
                        table = ((ab[:, 0] * (h % PRIME)[:, None] + ab[:, 1]) % PRIME).astype(np.int32)
                    ok = within(h, known)
                    at = place(h, known)
                    no = np.where(ok, number[at], -1) if len(known) else np.full(len(h), -1)
                    df = np.where(ok, held[at], 1).astype(float) if len(known) else np.ones(len(h))
                    w = np.log((n - df + 0.5) / (df + 0.5) + 1)
                    w = np.where(ok, w * w, 0)
                    df = np.where(ok, df, 0)
                    for j, r in enumerate(rows):
                        u = np.unique(ids[off[j] : off[j + 1]])
                        size[r] = len(u)
                        if not i:
                            sig[r] = table[u].min(axis=0)
                        mass[r] += w[u].sum()
                        own[r] += df[u].sum()
                        mine = np.sort(no[u])
                        mine = mine[np.searchsorted(mine, 0) :]
                        if n_set[r]:
                            mine = np.r_[decoded(expanded(codec, packed[r], n_set[r])), mine]
                        e = encoded(mine)
                        packed[r], n_set[r] = compressed(codec, e), len(e)
                        if last:  # elements of one text alone count in the norm only
                            alone = len(u) - len(mine)
                            mass[r] += alone * np.log((n - 0.5) / 1.5 + 1) ** 2
                            own[r] = (own[r] + alone) / len(u) / n
                bands = pa.array(list(band_keys(sig)), pa.list_(pa.int64())) if not i else b.column("bands")
                fps = [x[within(x, rare)] for x in prints(five)]
                if i:
                    fps = [np.r_[x, y].astype(np.int64) for x, y in zip(b.column("fps").to_pylist(), fps)]
                gone = pa.nulls(m, pa.binary()) if last else b.column("z")
                yield pa.RecordBatch.from_arrays([b.column("class_id"), b.column("copies"), b.column("k"), gone, b.column("n1"), pa.array(size),
                    pa.array(mass), pa.array(own), pa.array(n_set, pa.int32()), pa.array(packed, pa.binary()), bands, pa.array(fps, pa.list_(pa.int64()))],
                    names=[c.split()[0] for c in schema.split(", ")])

        for p, before in enumerate(out):
            out[p] = cut(before.mapInArrow(run, schema))
            if i:
                release(before)
        told.unpersist()
    return out, np.concatenate(by_number)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def memberships(sets: DataFrame) -> DataFrame:
    """(class_id, key): the buckets of two or more in which sets meet: those of MinHash
    bands, and one for each pair that shares three of the rare fingerprints `fps`."""
    w = Window.partitionBy("key")
    band = sets.select("class_id", F.explode("bands").alias("key"))
    band = band.select("class_id", "key", F.count(F.lit(1)).over(w).alias("n"), F.min("class_id").over(w).alias("first")).filter("n > 1")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    piece = F.when(F.col("class_id") == F.col("first"), F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.pmod(F.xxhash64("class_id"), pieces).cast("int")))
    band = band.select("class_id", "key", F.explode(piece).alias("piece")).select("class_id", F.when(F.col("piece") == 0, F.col("key")).otherwise(F.xxhash64("key", "piece")).alias("key"))
    held = sets.select("class_id", F.explode("fps").alias("f")).groupBy("f").agg(F.sort_array(F.collect_list("class_id")).alias("m"))
    pair = held.select("m", F.posexplode("m").alias("i", "a")).select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    pair = cut(pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter("shared >= 3"))
    free()
    pair = pair.select(F.explode(F.array("a", "b")).alias("class_id"), F.xxhash64("a", "b").alias("key"))
    return band.unionByName(pair)


def free() -> None:
    """Ask Python and Spark to delete the files of frames that nothing refers to any more."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    gc.collect()
    spark.range(1).count()  # Spark refers to its last job until the next one
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def accepted(sets: list[DataFrame], by_number: np.ndarray, n: int, least_score: float = 0.5, least_shared: int = 24) -> DataFrame:
    """(a, b, shared, jaccard, containment, cosine, commonness, small_in_large, score) of
    the pairs in a bucket that `similarity.accept` takes. All pairs of a bucket up to
    BUCKET members; a larger one gives a star around its smallest member and a chain.
    Buckets are handled in rounds by a hash; the sets are sent to those of a round only.
    `sets` are deleted when they are placed."""
    spark = sets[0].sparkSession
    kind = dict(sets[0].dtypes)["class_id"]
    keys = cut(memberships(union(sets)).groupBy("class_id").agg(F.collect_list("key").alias("keys")))
    free()
    placed, held, moved = [], 0, 0
    for part in sets:
        one, seen = cut_counted(part.select("class_id", "size", F.sqrt("mass").alias("norm"), "n_set", "packed").join(keys, "class_id"),
            held=F.sum(F.length("packed") + 60), moved=F.sum((F.length("packed") + 60) * F.size("keys")))
        placed, held, moved = [*placed, one], held + seen["held"], moved + seen["moved"]
        release(part)
        free()
    release(keys)
    rounds = max(1, int(-(-moved // max(LEAST_ROUND, SHARE * held))))
    steps = np.flatnonzero(np.diff(by_number, prepend=-1))  # counts fall by number, so there are few steps in a block
    told = spark.sparkContext.broadcast((steps, by_number[steps], len(by_number)))
    schema = f"a {kind}, b {kind}, shared int, jaccard double, containment double, cosine double, commonness double, small_in_large boolean, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, size_of = told.value
        df = np.append(np.repeat(values, np.diff(at, append=size_of)), 0).astype(np.int32)  # the last number stands for an empty set
        w = np.log((n - df + 0.5) / (df + 0.5) + 1)
        w *= w
        mark = np.zeros(size_of + 1, bool)
        codec, found, none = pa.Codec("zstd"), [], np.array([size_of])

        def meet(bucket: list[tuple], rows: int) -> None:
            """The first `rows` of the bucket, (id, size, norm, elements), each with all that follow it."""
            flat = np.concatenate([x[3] for x in bucket])
            ends = np.cumsum([len(x[3]) for x in bucket])
            weights, sizes, norms = w[flat], np.array([x[1] for x in bucket]), np.array([x[2] for x in bucket])
            for i in range(rows):
                x, end = bucket[i], ends[i]
                mark[x[3]] = True
                hit = mark[flat[end:]]
                mark[x[3]] = False
                starts = ends[i:-1] - end
                shared = np.add.reduceat(hit, starts, dtype=np.int32)
                dot = np.add.reduceat(weights[end:] * hit, starts)
                ok = (shared >= least_shared) & ((dot >= (least_score - 1e-6) * x[2] * norms[i + 1 :]) | (shared >= 0.8 * np.minimum(x[1], sizes[i + 1 :]) - 1e-6))
                for j in np.flatnonzero(ok).tolist():
                    y = bucket[i + 1 + j]
                    mine = df[y[3][hit[starts[j] : starts[j] + len(y[3])]]].astype(float)
                    weight = np.log((n - mine + 0.5) / (mine + 0.5) + 1)
                    k, least, most = len(mine), *sorted((x[1], y[1]))
                    cos, inside = float((weight * weight).sum()) / (x[2] * y[2]), k / least
                    high = inside >= 0.8 and inside > cos
                    score = inside if high else cos
                    if score >= least_score:
                        found.append((x[0], y[0], k, k / (least + most - k), inside, cos, float(mine.mean()) / n, 2 * least < most and high, score))

        bucket: list[tuple] = []
        key, many, first, last = None, False, None, None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "class_id", "size", "norm", "n_set", "packed")]
            for now, m, size, norm, n_set, z in zip(*cols):
                one = (m, size, norm, decoded(expanded(codec, z, n_set)) if n_set else none)
                if now != key:
                    if len(bucket) > 1:
                        meet(bucket, len(bucket) - 1)
                    key, many, bucket = now, False, []
                if many:
                    meet([first, one], 1)
                    meet([last, one], 1)
                    last = one
                    continue
                bucket.append(one)
                if len(bucket) > BUCKET:  # a star and a chain from here on
                    many, first, last = True, bucket[0], bucket[-1]
                    meet(bucket, 1)
                    for x, y in zip(bucket[1:], bucket[2:]):
                        meet([x, y], 1)
                    bucket = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=names).cast(target)
                found.clear()
        if len(bucket) > 1:
            meet(bucket, len(bucket) - 1)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=names).cast(target)

    names = [c.split()[0] for c in schema.split(", ")]
    ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    target = pa.schema(list(zip(names, [ids, ids, pa.int32(), *[pa.float64()] * 4, pa.bool_(), pa.float64()])))
    pairs = None
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # few bytes may be much work
    for r in range(rounds):
        key = F.explode(F.filter("keys", lambda k: F.pmod(k, F.lit(rounds)) == r))
        sent = union(placed).select(key.alias("key"), "class_id", "size", "norm", "n_set", "packed").repartition(tasks, "key").sortWithinPartitions("key", "class_id")
        mine = sent.select("key", "class_id", "size", "norm", "n_set", "packed").mapInArrow(run, schema)
        before, pairs = pairs, cut((mine if pairs is None else pairs.unionByName(mine)).dropDuplicates(["a", "b"]))
        if before is not None:
            release(before)
        del sent, mine, before
        free()
    release(*placed)
    return pairs
