"""Problem 7: evaluation texts leaking into training text.

Method: the n-grams of the normalised test items are a broadcast hash set; the
windows of every document are looked up in it batch by batch; hits are verified
by following the edit distance from equal stretches both ways, again and again on
what lies before and after a run; spans or whole
documents can then be removed.

A leak is a run of at least RUN consecutive item words in which at most one word
in ten is changed, dropped or added. Some 30 words of it then have at most 3
errors; the 27 others lie in at most 4 stretches and hold at least 27 - 4 * 4 = 11
windows of SEED words. So SEEDS places of the document with a hit of one item,
all within 33 words, are necessary, and only where they are found is anything
aligned. Where in the item the hits lie does not matter for that: a passage may
stand in it many times.

Normalisation: compatibility form, case folded, words are what stands between
white space, without anything that is not a letter or digit; words of marks alone
vanish. An opening that COMMON of all items share, however long, is an instruction
and is taken off the items first; openings are counted once, over the whole test
set. A passage in two items counts for both.

Scale: one narrow stage over the documents, no shuffle. The test set is collected
block by block, each of about BLOCK_CHARS characters, and a block is given up as
soon as it is broadcast; a test set above one block is scanned for in several
passes. So what the driver and an executor hold does not grow with the test set.

Defined results: null and empty texts leak nothing; repeated documents are found
each; repeated rows of an item count once; a text shorter than RUN words leaks
nothing; no items give an empty result.
"""

from __future__ import annotations

import bisect
import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import cut

RUN, ERRORS = 30, 0.1
#: Words of a window, windows that a run must hold, and words of the document they lie within.
SEED, SEEDS, REACH = 5, 11, 33
#: An opening of at least 4 words shared by this share of the items, and by 5 at least, is an instruction.
COMMON, COMMON_WORDS, COMMON_ITEMS = 0.1, 4, 5
BLOCK_CHARS = 20_000_000

_MARKS = re.compile(r"[^\w\s]|_")
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _MARKS.sub("", text.casefold()).split()


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) with places in the text as it is."""
    out = []
    for m in re.finditer(r"\S+", text):
        out += [(w, m.start(), m.end()) for w in words(m.group())]
    return out


def opening_hashes(ws: list[str]) -> list[int]:
    """A hash of the first COMMON_WORDS words, of one more, and so on to all."""
    out, h = [], 0
    for k, w in enumerate(ws, 1):
        h = xxhash.xxh64_intdigest(f"{h} {w}")
        if k >= COMMON_WORDS:
            out.append(h - (1 << 63))
    return out


def with_openings(items: DataFrame, n: int) -> DataFrame:
    """(k, t, lead): `n` distinct items (k, t) with the number of words that are an
    instruction. Openings of all lengths are counted over all items; of one length
    at most 1 / COMMON are common, so what is joined back is short."""
    least = F.lit(max(COMMON_ITEMS, COMMON * n))
    kind = dict(items.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1),
                pa.array([opening_hashes(words(t)) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["k", "t", "h"])

    hashed = items.mapInArrow(run, f"k {kind}, t string, h array<bigint>")
    long = hashed.select(F.struct("k", "t").alias("item"), F.posexplode("h").alias("i", "h"))
    common = long.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("h")
    lead = long.join(common, "h", "left_semi").groupBy("item").agg((F.max("i") + COMMON_WORDS).alias("lead"))
    return items.select(F.struct("k", "t").alias("item")).join(lead, "item", "left").select("item.k", "item.t", F.coalesce("lead", F.lit(0)).alias("lead"))


class Index:
    """The items' words as numbers and their n-grams, sorted by hash."""

    def __init__(self, ids: list, texts: list[str], leads: list[int] | None = None):
        kept = [words(t)[lead:] for t, lead in zip(texts, leads or [0] * len(texts))]
        self.ids = ids
        self.vocab: dict[str, int] = {}
        self.items = [[self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws] for ws in kept]
        grams, owner = [], []
        for k, ws in enumerate(self.items):
            if len(ws) >= RUN:
                g = hashes(np.asarray(ws, np.uint64))
                grams.append(g)
                owner.append(np.full(len(g), k, np.int32))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        g, self.owner = cat(grams, np.uint64), cat(owner, np.int32)
        order = np.argsort(g, kind="stable")
        self.grams, self.owner = g[order], self.owner[order]


def hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of every SEED words in a row; 0 where a word is unknown."""
    n = len(ids) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for j in range(SEED):
        part = ids[j : j + n]
        h = h * _P + part
        h ^= h >> np.uint64(29)
        known &= part != 0
    h[h == 0] = 1
    h[~known] = 0
    return h


def _blocks_of(item: list[int], doc: list[int], lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(item place, doc place, words) of the maximal equal stretches of SEED words
    or more within doc[lo:hi]."""
    at: dict[tuple, list[int]] = {}
    for i in range(len(item) - SEED + 1):
        at.setdefault(tuple(item[i : i + SEED]), []).append(i)
    out, upto = [], {}
    for j in range(lo, hi - SEED + 1):
        for i in at.get(tuple(doc[j : j + SEED]), ()):
            if upto.get(i - j, -1) > j:
                continue
            n = SEED
            while i + n < len(item) and j + n < hi and item[i + n] == doc[j + n]:
                n += 1
            upto[i - j] = j + n - SEED + 1
            out.append((i, j, n))
    return out


def _reach(item: list[int], doc: list[int], i0: int, j0: int, end: int, step: int, most: int) -> list[tuple[int, int]]:
    """For 0, 1, ... `most` errors how many item and document words can follow
    (step 1) or precede (step -1) the places i0 and j0, ending on an equal word;
    by furthest points on the diagonals."""
    wide, deep = (len(item) - i0 if step > 0 else i0 + 1), (end - j0 if step > 0 else j0 - end + 1)
    front, out, best = {0: 0}, [(0, 0)], (0, 0)
    for _ in range(most):
        new: dict[int, int] = {}
        for d, x in front.items():  # x item words and x - d document words are behind
            for nd, nx in ((d, x + 1), (d + 1, x + 1), (d - 1, x)):  # changed, dropped, added
                if nx <= wide and nx - nd <= deep and nx > new.get(nd, -1):
                    new[nd] = nx
        for d, x in new.items():
            y = x
            while y < wide and y - d < deep and item[i0 + step * y] == doc[j0 + step * (y - d)]:
                y += 1
            new[d] = y
            if y > x and y > best[0]:
                best = (y, y - d)
        front = new
        out.append(best)
        if not new:
            break
    return out


def extend(item: list[int], doc: list[int], i: int, j: int, size: int, lo: int, hi: int) -> tuple[int, int, int, int] | None:
    """(item words, errors, first and last place in `doc`) of the longest run
    within doc[lo:hi] that holds the equal stretch of `size` words from item place
    i and document place j; None if there is none of RUN words. The edit distance
    is followed from the stretch both ways."""
    best = None
    most = int(ERRORS * len(item)) + 1
    after = _reach(item, doc, i + size, j + size, hi, 1, most)
    before = _reach(item, doc, i - 1, j - 1, lo, -1, most)
    for e, (n1, m1) in enumerate(after):
        for f, (n0, m0) in enumerate(before):
            n, errors = n0 + size + n1, e + f
            # errors inside the run; words beyond the last match may be errors too
            spare = max(0, min(int(ERRORS * RUN) - errors, len(item) - n)) if n < RUN else 0
            if n + spare >= RUN and errors + spare <= ERRORS * (n + spare) and (best is None or (n, -errors) > (best[0], -best[1])):
                best = (n, errors, j - m0, j + size + m1)
    return best


def runs(item: list[int], doc: list[int], lo: int, hi: int) -> list[tuple[int, int, int, int]]:
    """Disjoint runs of the item in doc[lo:hi], the longest first and then the
    longest of what is left free, again and again; by place. Every run holds an
    equal stretch of SEED words, so each of these is extended; one that meets a run
    taken before is extended once more within what is free."""
    heap: list[tuple] = []

    def push(i: int, j: int, size: int, a: int, z: int) -> None:
        if r := extend(item, doc, i, j, size, a, z):
            heapq.heappush(heap, (-r[0], r[1], j, i, size, r))

    for i, j, size in _blocks_of(item, doc, lo, hi):
        push(i, j, size, lo, hi)
    taken: list[tuple[int, int]] = []
    out = []
    while heap:
        _, _, j, i, size, r = heapq.heappop(heap)
        k = bisect.bisect_right(taken, (r[2], hi + 1))
        if (not k or taken[k - 1][1] <= r[2]) and (k == len(taken) or r[3] <= taken[k][0]):
            taken.insert(k, (r[2], r[3]))
            out.append(r)
            continue
        k = max(bisect.bisect_right(taken, (j, hi + 1)) - 1, 0)  # the free parts of the stretch itself
        at = j
        while at < j + size:
            while k < len(taken) and taken[k][1] <= at:
                k += 1
            if k < len(taken) and taken[k][0] <= at:
                at = taken[k][1]
                continue
            end = min(j + size, taken[k][0] if k < len(taken) else hi)
            if end - at >= SEED:
                push(i + at - j, at, end - at, taken[k - 1][1] if k else lo, taken[k][0] if k < len(taken) else hi)
            at = end
    return sorted(out, key=lambda r: r[2])


def best_run(item: list[int], doc: list[int]) -> tuple[int, int, int, int]:
    """The longest run of the item in `doc`; 0 words if it has less than RUN."""
    return max(runs(item, doc, 0, len(doc)), default=(0, 0, 0, 0), key=lambda r: (r[0], -r[1]))


def scan(index: Index, docs: list[list[int]]) -> list[list[tuple]]:
    """Per document the leaks (item number, words, errors, first, last word)."""
    out: list[list[tuple]] = [[] for _ in docs]
    if not docs or not len(index.grams):
        return out
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = np.zeros(int(sizes.sum()) + len(docs), np.uint64)  # a zero between documents
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    for s, d in zip(starts, docs):
        flat[s : s + len(d)] = d
    h = hashes(flat)
    left = np.searchsorted(index.grams, h, "left")
    right = np.searchsorted(index.grams, h, "right")
    at = np.nonzero((h != 0) & (right > left))[0]
    if not len(at):
        return out
    # every hit with each of its items; of one item a place of a document counts once
    times = right[at] - left[at]
    p = np.repeat(at, times)
    g = np.repeat(left[at], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    key = (np.searchsorted(starts, p, "right") - 1) * len(index.items) + index.owner[g]
    order = np.lexsort((p, key))
    key, p = key[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (key[1:] != key[:-1]) | (p[1:] != p[:-1])
    key, p = key[new], p[new]
    k = SEEDS - 1
    if len(p) <= k:
        return out
    dense = (key[k:] == key[:-k]) & (p[k:] - p[:-k] <= REACH)
    spans: dict[int, list[list[int]]] = {}
    for x in np.nonzero(dense)[0].tolist():
        d, i = divmod(int(key[x]), len(index.items))
        room = RUN + len(index.items[i]) * 11 // 10  # a run ends within this of its hits
        a, z = int(p[x] - starts[d]) - room, int(p[x + k] - starts[d]) + SEED + room
        own = spans.setdefault(int(key[x]), [])
        if own and a <= own[-1][1]:
            own[-1][1] = z
        else:
            own.append([a, z])
    for x, own in spans.items():
        d, i = divmod(x, len(index.items))
        for a, z in own:
            out[d] += [(i, *r) for r in runs(index.items[i], docs[d], max(a, 0), min(z, len(docs[d])))]
    return out


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[Index]:
    """The items in indexes of a bounded size each, one at a time."""
    one = items.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    one = cut(one)
    size = one.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("total")).first()
    led = with_openings(one, size["n"])
    n = -(-size["total"] // BLOCK_CHARS) or 1
    if n > 1:
        led = cut(led)
    for b in range(n):
        part = led if n == 1 else led.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b)
        rows = sorted(part.collect(), key=lambda r: (r.k, r.t))  # about BLOCK_CHARS characters
        yield Index([r.k for r in rows], [r.t for r in rows], [r.lead for r in rows])


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(doc, item, n_words, n_errors, start, end): one row per leaked passage, with
    the places of its first and last character in the text."""
    src = docs.filter(F.col(text).isNotNull()).select(F.col(doc).alias("k"), F.col(text).alias("t"))
    kind, item_kind = dict(src.dtypes)["k"], dict(items.dtypes)[item]
    schema = f"k {kind}, item {item_kind}, n_words int, n_errors int, start int, end int"
    out = None
    for index in _blocks(items, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        del index  # the broadcast is a file; the driver keeps no block

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            get = ix.vocab.get
            for b in batches:
                texts = b.column(1).to_pylist()
                found = scan(ix, [[get(w, 0) for w in words(t)] for t in texts])
                rows = []
                for k, t, f in zip(b.column(0).to_pylist(), texts, found):
                    if f:
                        places = placed_words(t)
                        for i, n, e, a, z in f:
                            a, z = min(a, len(places) - 1), min(z, len(places))
                            rows.append((k, ix.ids[i], n, e, places[a][1], places[z - 1][2]))
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int64() if item_kind == "bigint" else pa.string()),
                        *(pa.array(c, pa.int32()) for c in cols[2:])],
                    names=["k", "item", "n_words", "n_errors", "start", "end"],
                )

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("k", doc).withColumnRenamed("item", item)


def remove_spans(docs: DataFrame, doc: str, text: str, spans: DataFrame) -> DataFrame:
    """`docs` with the leaked passages cut out of `text`. The spans of a document
    are joined back to it, so only documents with leaks are touched."""
    per = spans.groupBy(doc).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    t = F.col(text)
    # what lies before each span and after the last; overlapping spans are merged by the running end
    state = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("upto")),
        lambda s, x: F.struct(F.concat(s["kept"],
            F.when(x["start"] > s["upto"], F.substring(t, s["upto"] + 1, x["start"] - s["upto"])).otherwise("")).alias("kept"),
                F.greatest(s["upto"], x["end"]).alias("upto")),
        lambda s: F.concat(s["kept"], F.substring(t, s["upto"] + 1, F.length(t))),
    )
    return docs.join(per, doc, "left").withColumn(text, F.when(F.col("_spans").isNull(), t).otherwise(state)).drop("_spans")


def _spans(spark, sf_dir: str) -> DataFrame:
    from ..tables import table

    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_found(spark, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_spans(spark, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


def p7_items(spark, sf_dir: str) -> DataFrame:
    """How many documents and feeds each item leaked into."""
    from ..tables import table

    hit = _spans(spark, sf_dir).select("doc_id", "item_id").distinct().join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return hit.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("source").alias("n_sources"))


def p7_cleaned(spark, sf_dir: str) -> DataFrame:
    from ..tables import table

    return remove_spans(table(spark, sf_dir, "documents"), "doc_id", "text", _spans(spark, sf_dir)).select("doc_id", "text")
