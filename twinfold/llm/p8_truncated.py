"""Problem 8: text cut off by field limits.

Method: intact values are cut artificially to make positives, a logistic
regression on hashed features of the ending is trained on them, and every record
is scored. Negatives are the values as they are and values shortened to the end
of a block, which is a complete ending too. Values that were really cut stand
among the negatives at first; the model is fitted, finds them, moves them to the
positives and is fitted again.

Features: closing characters and their shapes, punctuation, the kind of the last
line (prose, list, table, heading, code, link, comment, signature), whether code
spans, code blocks, brackets and table rows are closed, how the last sentence and
the last list item begin and how long they are, and the length against the limits
of the source, which are the lengths that occur conspicuously often in it. Lengths
are counted over distinct texts, so copies of one text make no limit.

Scale: the lengths per source are counted over all records, of which source,
length and a hash of the text are shuffled; at most SAMPLE records (a documented
bound) are used for training. Records are picked by a hash of the key, and of
equal texts among them one is used, so a text with very many copies does not swell
the sample; a limit on the rows keeps the bound whatever the keys are. Their
hashed features, some megabytes, are all that is sent to the driver; the weights
(1 MB) are broadcast and scoring is one narrow stage over whole texts.

Defined results: null, empty and blank texts are never cut (score null);
repeated records score alike; records without a source have no limit; with no
records that can be cut to train on, every score is null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import cut

#: Records used for training at most.
SAMPLE = 8_000
#: Training rows that one record gives at most: itself, 3 cuts, 2 shortened to the end of a block.
MADE = 6
BITS = 18
#: A length is a limit if this many distinct texts of a source have it, and this share of them.
LIMIT_ROWS, LIMIT_SHARE = 5, 0.01
THRESHOLD = 0.5
#: Limits are broadcast up to this many sources.
BROADCAST_ROWS = 100_000
#: Artificial cuts leave at least this many characters; limits below do not hold texts.
SHORTEST = 48

_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
_LIST = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s+)?")
_SENT = re.compile(r"(?<=[.!?…:])[\"'»”)\]]*\s+|\n\s*\n")
_SHAPES = (
    (re.compile(r"[^\W\d_]+(?<=[a-zß-ÿ])"), "w"),
    (re.compile(r"\d+"), "9"),
    (re.compile(r"w(?: w)+"), "w+"),
)


def shape(s: str) -> str:
    for p, by in _SHAPES:
        s = p.sub(by, s)
    return s


def char_class(c: str) -> str:
    return "9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else "_" if c.isspace() else c


def features(text: str) -> tuple[list[int], list[int], list[int]]:
    """Hashed features of the ending of a text that is not blank: those of the
    ending alone, and those to add if its length is not, or is, the limit."""
    body = text.rstrip()
    dots = "…" if body.endswith("…") else "..." if body.endswith("...") else ""
    core = body[: len(body) - len(dots)] if dots else body
    core_r = core.rstrip()
    line = core_r.rpartition("\n")[2]
    s = line.strip()
    above = core_r[: len(core_r) - len(line)].rstrip("\n")
    above_line = above.rpartition("\n")[2].strip()
    fences = len(_FENCE.findall(core_r))
    para = core_r.replace("\r", "").rpartition("\n\n")[2]
    if fences % 2:
        kind = "code"
    elif _FENCE.match(line):
        kind = "fence"
    elif s.startswith("|"):
        kind = "table"
    elif _LIST.match(line):
        kind = "list"
    elif s.startswith("#"):
        kind = "heading"
    elif s.startswith("<!--"):
        kind = "comment"
    elif re.match(r"https?://\S*$", s):
        kind = "url"
    elif re.match(r"(?:--|—|–)\s*\w", s) and len(s) < 60:
        kind = "signature"
    elif s.startswith("["):
        kind = "links"
    elif s.startswith(">"):
        kind = "quote"
    else:
        kind = "prose"
    last = s[-1:] or "∅"
    words = s.split()
    w1, w2 = (words[-1] if words else ""), " ".join(words[-2:])
    sents = _SENT.split(para)
    sent = sents[-1] if sents[-1].strip() else (sents[-2] if len(sents) > 1 else "")
    sw = sent.split()
    ended = last in ".!?。" or s[-2:] in (".)", '."', ".”", ".»", ".*", "._")
    ticks = s.count("`") % 2
    open_ = (s.count("(") > s.count(")")) + 2 * (s.count("[") > s.count("]")) + 4 * (s.count("«") > s.count("»")) + 8 * (s.count('"') % 2) + 16 * (s.count("**") % 2)
    single = "\n" not in core_r
    tail = text[len(body) :]
    sh = shape(s)
    f = [
        "b", f"k{kind}", f"d{dots}", f"kd{kind}{dots}", f"t{'n' if tail.startswith(chr(10)) else 's' if tail else ''}",
            f"kt{kind}{'n' if tail.startswith(chr(10)) else 's' if tail else ''}",
        f"kc{kind}{char_class(last)}", f"kcd{kind}{char_class(last)}{dots}", f"k2{kind}{''.join(map(char_class, s[-2:]))}", f"k3{kind}{''.join(map(char_class, s[-3:]))}",
        f"ke{kind}{ended}{dots}", f"ti{kind}{ticks}", f"op{kind}{open_}", f"w1{w1[-24:]}", f"kw1{kind}{w1[-24:].lower()}", f"w2{w2[-40:]}", f"sg{single}{kind}{ended}",
        f"sn{kind}{min(len(sw), 12)}{ended}", f"s3{' '.join(sw[:3])[:40]}{dots}", f"s2{' '.join(sw[:2])[:30]}{ended}{dots}", f"sh{kind}{sh[-14:]}",
            f"shl{kind}{sh[:60]}" if kind != "prose" else f"shp{sh[-24:]}",
        f"w1s{shape(w1)[-16:]}{kind}",
    ]
    if single:
        f += [f"1l{min(len(body) // 16, 12)}", f"1w{' '.join(words[:3])[:40]}", f"1e{w2[-40:]}{ended}",
            f"1n{len(words) if len(words) < 14 else 14}{words[0][:1].islower() if words else ''}"]
    if len(body) < SHORTEST:
        f += [f"xs{i}" for i in range(8)]  # several, so that length weighs as much as the words, which may be new
    if kind == "list":
        item = _LIST.sub("", line, count=1)
        head, colon, rest = item.partition(": ")
        rw = rest.split()
        prev = _LIST.sub("", above_line, count=1).partition(": ")[2].split()
        f += [f"lc{bool(colon)}{len(rw)}", f"lf{rw[0].lower() if rw else ''}{len(rw)}", f"lp{len(rw) - len(prev) if prev else 'x'}",
            f"lw{rw[-1].lower() if rw else ''}", f"lb{len(rw)}{prev[:1] == rw[:1]}{len(prev) == len(rw)}"]
    if kind == "table":
        f += [f"tp{s.count('|') - above_line.count('|') if above_line.startswith('|') else 'x'}", f"te{s.endswith('|')}",
            f"tc{s.endswith('|')}{s.count('|') == above_line.count('|')}"]
    if kind == "fence":
        f += [f"fl{s[:12]}{fences % 2}"]
    mask = (1 << BITS) - 1
    h = xxhash.xxh32_intdigest
    limit = [[h(x) & mask for x in (f"lim{a}", f"klim{kind}{a}{ended}", f"dlim{dots}{a}{ended}")] for a in (0, 1)]
    return sorted({h(x) & mask for x in f}), *limit


def artificial(text: str) -> list[tuple[int, tuple]]:
    """Training rows of one value: (label, features), the value itself first.
    Labels: 0 complete, 1 cut, 2 cut with dots at the cut."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(text))
    rows = [(0, features(text))]
    n = len(text)
    for _ in range(3):
        if n < SHORTEST + 8:
            break
        k = int(rng.integers(SHORTEST, n - 3))
        piece = text[:k]
        if not piece.strip() or _complete(text, k):
            continue
        dots = ("", "", "", "…", "...")[int(rng.integers(5))]
        if dots:
            piece = piece[: max(SHORTEST, k - len(dots))]
            if _complete(text, len(piece)):
                continue
        rows.append((2 if dots else 1, features(piece + dots)))
    ends = [m.start() for m in re.finditer(r"\n", text) if m.start() > 12]
    for _ in range(2):
        if ends:
            piece = text[: ends[int(rng.integers(len(ends)))]]
            lines = piece.rstrip().rsplit("\n", 1)[-1]
            if piece.strip() and len(_FENCE.findall(piece)) % 2 == 0 and not re.match(r"\s*(?:#|\|[-:| ]+\|?$)", lines):
                rows.append((0, features(piece)))
    return rows


def fold_of(text: str) -> int:
    return xxhash.xxh32_intdigest(text.rstrip()[-32:])


def _complete(text: str, k: int) -> bool:
    """Whether text[:k] stops where something ends, so that it is no positive."""
    a, b = text[:k], text[k:]
    if len(_FENCE.findall(a)) % 2:
        return False
    if not b.strip():
        return True
    end = a.rstrip()
    return (b[:1] == "\n" or a[-1:] == "\n") or end[-1:] in ".!?" and (a[-1:].isspace() or b[:1].isspace())


def fit(y: np.ndarray, rows: list[np.ndarray], weight: np.ndarray, rounds: int = 60, l2: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression on binary hashed features (AdaGrad over the whole sample)."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), sizes)
    w = np.zeros(1 << BITS)
    g2 = np.full(1 << BITS, 1e-8)
    total = weight.sum()
    for _ in range(rounds):
        z = np.bincount(owner, w[flat], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(flat, ((p - y) * weight)[owner], 1 << BITS) / total + l2 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return w


def scores(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = np.fromiter((w[r].sum() for r in rows), float, len(rows))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(made: np.ndarray, rows: list[np.ndarray], off: list[np.ndarray], on: list[np.ndarray], real: np.ndarray, at: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """Fit on the endings alone, move the values that were really cut to the
    positives, and fit again with the length against the limit. Artificial cuts
    stand at the limit as often as the real ones do, those with dots always: dots
    come from what enforces a limit. Values are judged in three folds by their
    ending, or the model would know each, or a copy of it, by heart as a negative."""
    n = len(made)
    y = (made > 0).astype(float)
    own = np.nonzero(real)[0]
    fold = ending % 3
    label, weight, used = y, np.ones(n), rows
    for _ in range(2):
        p = np.zeros(n)
        for k in range(3):  # a value is judged by a model that has not seen it
            keep, test = np.nonzero(fold != k)[0], own[fold[own] == k]
            w = fit(label[keep], [used[i] for i in keep], weight[keep])
            p[test] = scores(w, [used[i] for i in test])
        q = p[own]
        label, weight = y.copy(), np.ones(n)
        label[own] = q > 0.5
        weight[own] = np.where(np.abs(q - 0.5) > 0.2, 2.0, 0.0)  # the doubtful ones do not teach
        here = at.astype(bool).copy()
        share = here[own][q > 0.5].mean() if (q > 0.5).any() else 0.0
        here[made == 1] = np.random.default_rng(1).random(int((made == 1).sum())) < share
        here[made == 2] = True
        used = [np.concatenate([r, b if h else a]) for r, a, b, h in zip(rows, off, on, here)]
    return fit(label, used, weight).astype(np.float32)


def lengths(docs: DataFrame, text: str, source: str) -> DataFrame:
    """(source, n, texts, records): how many distinct texts and how many records
    that are not blank have a length in a source."""
    one = docs.filter(F.length(F.trim(text)) > 0).select(F.col(source).alias("source"), F.length(text).alias("n"), F.xxhash64(text).alias("h"))
    per = one.groupBy("source", "n", "h").agg(F.count(F.lit(1)).alias("records"))
    return per.groupBy("source", "n").agg(F.count(F.lit(1)).alias("texts"), F.sum("records").alias("records"))


def limits(counted: DataFrame) -> DataFrame:
    """(source, limits): the lengths that occur conspicuously often in a source, at
    most 1 / LIMIT_SHARE of them."""
    every = counted.groupBy("source").agg(F.sum("texts").alias("all"))
    top = counted.filter((F.col("texts") >= LIMIT_ROWS) & (F.col("n") >= 64)).join(every, "source").filter(F.col("texts") >= F.col("all") * LIMIT_SHARE)
    return top.groupBy(F.col("source").alias("_source")).agg(F.collect_list("n").alias("_limits"))


def _limited(docs: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, int]:
    """((k, source, t, at), how many of them are not blank)."""
    counted = cut(lengths(docs, text, source))
    n = counted.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    lim = cut(limits(counted))
    if lim.count() <= BROADCAST_ROWS:  # one row per source; with more sources than that the join is left to Spark
        lim = F.broadcast(lim)
    j = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).alias("source")).join(lim, F.col("source") == F.col("_source"), "left")
    near = F.exists("_limits", lambda x: F.abs(F.length("t") - x) <= 1)
    return j.select("k", "source", "t", F.coalesce(near, F.lit(False)).cast("int").alias("at")), n


def sampled(rows: DataFrame, n: int, sample: int = SAMPLE) -> DataFrame:
    """(t, at) of distinct texts of about `sample` of the `n` rows that are not
    blank; five deviations below it, so that more are hardly ever picked."""
    share = 1.0 if n <= sample else max(sample - 5 * math.sqrt(sample), 1) / n
    parts = 1 << 40
    picked = rows.filter(F.length(F.trim("t")) > 0).filter(F.pmod(F.xxhash64("k"), F.lit(parts)) < int(share * parts))
    return picked.groupBy(F.xxhash64("t").alias("h")).agg(F.min(F.struct("k", "t", "at")).alias("r")).select("r.t", "r.at")


def model(rows: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights trained on at most `sample` of the `n` rows (k, t, at)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, first, at, ending = [], [], [], []
            parts: tuple[list, list, list] = ([], [], [])
            for t, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t.strip():
                    continue
                for i, (label, f) in enumerate(artificial(t)):
                    y.append(label)
                    first.append(i == 0)
                    at.append(a if i == 0 else 0)
                    ending.append(fold_of(t))
                    for c, x in zip(parts, f):
                        c.append(x)
            cols = [pa.array(y, pa.int32()), pa.array(first, pa.bool_()), pa.array(at, pa.int32()), pa.array(ending, pa.int64()),
                *(pa.array(c, pa.list_(pa.int32())) for c in parts)]
            yield pa.RecordBatch.from_arrays(cols, names=["y", "first", "at", "ending", "f", "off", "on"])

    made = sampled(rows, n, sample).mapInArrow(make, "y int, first boolean, at int, ending long, f array<int>, off array<int>, on array<int>")
    got = made.limit(MADE * sample).toArrow()  # a bound for keys that are equal or hash alike
    y = got.column("y").to_numpy()
    if not y.any() or y.all():
        return None

    def lists(name: str) -> list[np.ndarray]:
        col = got.column(name).combine_chunks()
        o, flat = col.offsets.to_numpy(), col.values.to_numpy()
        return [flat[o[i] : o[i + 1]] for i in range(len(y))]

    return train(y, lists("f"), lists("off"), lists("on"), got.column("first").to_numpy(zero_copy_only=False), got.column("at").to_numpy(),
        got.column("ending").to_numpy())


def score(docs: DataFrame, key: str, text: str, source: str, sample: int = SAMPLE) -> DataFrame:
    """(key, source, score): how sure the text was cut, for every record."""
    rows, n = _limited(docs, key, text, source)
    w = model(rows, n, sample)
    kind = dict(rows.dtypes)["k"]
    if w is None:
        return rows.select(F.col("k").alias(key), "source", F.lit(None).cast("double").alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            out = []
            for t, a in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if t is None or not t.strip():
                    out.append(None)
                    continue
                base, off, on = features(t)
                z = float(w[base].sum() + w[on if a else off].sum())
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["k", "source", "score"])

    return rows.mapInArrow(run, f"k {kind}, source string, score double").withColumnRenamed("k", key)


def _scored(spark, sf_dir: str) -> DataFrame:
    from ..tables import table

    return score(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p8_found(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter(F.col("score") > THRESHOLD).select("doc_id")


def p8_rates(spark, sf_dir: str) -> DataFrame:
    """(source, n_docs, n_cut, rate) over the records that are not blank."""
    g = _scored(spark, sf_dir).filter("score IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
        F.sum((F.col("score") > THRESHOLD).cast("long")).alias("n_cut"))
    return g.withColumn("rate", F.round(F.col("n_cut") / F.col("n_docs"), 6))
