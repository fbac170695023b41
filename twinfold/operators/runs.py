"""Runs of equal lines shared by files, found from windows of K lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .scale import cut, lookup, spread
from .similarity import hash60

#: Lines of a window, and of the shortest run that is reported.
K, LEAST = 5, 6


def line_windows(files: DataFrame, key: str, lang: Column, src: str, k: int = K) -> DataFrame:
    """(file, lang, pos, gram): hashes of k significant lines in a row; pos counts
    the significant lines of a file from 0."""
    lines = F.filter(F.transform(F.split(F.col(src), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), lambda x: ~T.is_trivial_line(x))
    rows = spread(files.filter(F.col(src).isNotNull())).select(F.col(key).alias("file"), lang.alias("lang"), lines.alias("l")).filter(F.size("l") >= k)
    grams = F.transform(T.windows(F.col("l"), k), lambda s: F.concat_ws("\n", *(s[f"x{i}"] for i in range(k))))
    return rows.select("file", "lang", F.posexplode(grams).alias("pos", "t")).select("file", "lang", "pos", hash60("t").alias("gram"))


def shared_runs(windows: DataFrame, k: int = K, least: int = LEAST) -> DataFrame:
    """(a, b, a_pos, b_pos, lines): maximal runs of b whose windows all occurred
    first in a, in step. Every window is compared with its first occurrence only,
    so a window held by a million files costs a million rows, not all their pairs."""
    first = windows.groupBy("lang", "gram").agg(F.min(F.struct("file", "pos")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = windows.withColumn("g", F.struct("lang", "gram"))
    j = lookup(keyed, first.select(F.struct("lang", "gram").alias("g"), F.col("f.file").alias("a"), F.col("f.pos").alias("a_pos")), "g")
    j = j.filter("a <> file").select("a", F.col("file").alias("b"), "a_pos", F.col("pos").alias("b_pos"), (F.col("a_pos") - F.col("pos")).alias("d"))
    island = F.col("b_pos") - F.row_number().over(Window.partitionBy("a", "b", "d").orderBy("b_pos"))
    runs = j.withColumn("i", island).groupBy("a", "b", "d", "i").agg(F.min("a_pos").alias("a_pos"), F.min("b_pos").alias("b_pos"),
        (F.count(F.lit(1)) + k - 1).alias("lines"))
    return runs.filter(F.col("lines") >= least).select("a", "b", "a_pos", "b_pos", "lines")


def significant_lines(files: DataFrame, key: str, src: str) -> DataFrame:
    """(file, pos, line): the source line of every significant line."""
    numbered = F.transform(F.split(F.col(src), "\n"), lambda x, i: F.struct((i + 1).alias("no"), F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")).alias("t")))
    kept = F.filter(numbered, lambda x: ~T.is_trivial_line(x["t"]))
    return files.filter(F.col(src).isNotNull()).select(F.col(key).alias("file"), F.posexplode(F.transform(kept, lambda x: x["no"])).alias("pos", "line"))


def with_lines(runs: DataFrame, files: DataFrame, key: str, src: str) -> DataFrame:
    """`runs` with a_from, a_to, b_from, b_to: the source lines that they cover."""
    asked = runs.select(F.col("a").alias("file")).unionByName(runs.select(F.col("b").alias("file"))).distinct()
    at = significant_lines(files.join(asked.withColumnRenamed("file", key), key, "left_semi"), key, src)
    out = runs
    for side in "ab":
        for name, pos in (("from", F.col(f"{side}_pos")), ("to", F.col(f"{side}_pos") + F.col("lines") - 1)):
            out = out.withColumn("pos", pos.cast("int")).join(at.select(F.col("file").alias(side), "pos", F.col("line").alias(f"{side}_{name}")),
                [side, "pos"]).drop("pos")
    return out.select("a", "b", "a_pos", "b_pos", "lines", "a_from", "a_to", "b_from", "b_to")


def marked_lines(files: DataFrame, key: str, src: str, mark: str) -> DataFrame:
    """(file, start, end): lines that hold a mark which asks to leave them out."""
    lines = F.transform(F.split(F.col(src), "\n"), lambda x, i: F.when(x.contains(mark), i + 1))
    return files.filter(F.col(src).isNotNull()).select(F.col(key).alias("file"),
        F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("start")).withColumn("end", F.col("start"))


def without_marked(runs: DataFrame, marked: DataFrame) -> DataFrame:
    """`runs` of which no side covers a marked range: an anti-join on ranges."""
    from .spans import overlap_join

    keyed = runs.withColumn("id", F.struct("a", "b", "a_pos", "b_pos"))
    hit = None
    for side in "ab":
        part = overlap_join(keyed.select("id", F.col(side).alias("file"), F.col(f"{side}_from").alias("start"), F.col(f"{side}_to").alias("end")), marked).select("id")
        hit = part if hit is None else hit.unionByName(part)
    return keyed.join(hit.distinct(), "id", "left_anti").drop("id")


#: Tokens of a window, tokens and lines of the shortest token run.
TOKEN_K, TOKEN_LEAST, LINE_LEAST = 10, 24, 5
# A token: a word, a number, a string, a sign; comments by language family (fixed patterns).
TOKEN = r"""[A-Za-z_]\w*|[0-9][\w.]*|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s\w]"""
HASH_COMMENTS = ("python", "ruby")
# Words that stand for themselves (fixed values); every other word is a name.
WORDS = (
    "if", "else", "for", "while", "do", "return", "break", "continue", "switch", "case", "try", "catch", "except", "finally", "throw", "raise", "def",
        "function", "func", "fn", "class", "struct", "import", "from", "use", "package",
    "const", "let", "var", "new", "in", "not", "and", "or", "await", "async", "yield", "match", "end", "elif", "with", "go", "defer",
)
# Tokens that compute something; a run without one is a list of names.
OPERATIONS = ("(", "=", "+", "-", "*", "/", "%", "<", ">", "&", "|", "!", "if", "for", "while", "return", "break", "continue", "throw", "raise", "try", "switch", "case")


def token_stream(files: DataFrame, key: str, lang: Column, src: str) -> DataFrame:
    """(file, lang, tags, lines): the tokens of a file as kinds, names and literals
    blind, and the line of each. Lexed line by line, so a string over several lines
    gives the tokens of its lines."""
    bare = lambda x: F.when(F.col("lang").isin(*HASH_COMMENTS), F.regexp_replace(x, r"#.*\z", "")).otherwise(F.regexp_replace(x, r"//.*\z", ""))
    kind = lambda w: F.when(w.isin(*WORDS), w).when(w.rlike(r"\A[A-Za-z_]"), "I").when(w.rlike(r"\A[0-9]"), "N").when(w.rlike(r"\A[\"'].+"),
        "S").otherwise(w)
    rows = spread(files.filter(F.col(src).isNotNull())).select(F.col(key).alias("file"), lang.alias("lang"), F.split(F.regexp_replace(src, "\r", ""), "\n").alias("x"))
    toks = F.transform("x", lambda x, i: F.transform(F.regexp_extract_all(bare(x), F.lit(TOKEN), F.lit(0)), lambda w: F.struct(kind(w).alias("t"), (i + 1).alias("i"))))
    flat = rows.select("file", "lang", F.flatten(toks).alias("s")).filter(F.size("s") > 0)
    return flat.select("file", "lang", F.transform("s", lambda s: s["t"]).alias("tags"), F.transform("s", lambda s: s["i"]).alias("lines"))


def token_windows(stream: DataFrame, k: int = TOKEN_K) -> DataFrame:
    """(file, lang, pos, gram): hashes of k tokens in a row."""
    grams = F.transform(T.windows(F.col("tags"), k), lambda s: F.concat_ws(" ", *(s[f"x{i}"] for i in range(k))))
    long = stream.filter(F.size("tags") >= k).select("file", "lang", F.posexplode(grams).alias("pos", "t"))
    return long.select("file", "lang", "pos", hash60("t").alias("gram"))


def extended_runs(stream: DataFrame, k: int, least: int) -> DataFrame:
    """(a, b, a_pos, b_pos, length): maximal runs of equal tokens of b and a in step,
    where a holds the first occurrence of one of the run's windows at least. The first
    occurrence is the seed; the run goes as far as both files stay equal, whoever else
    held its parts before. A file meets only the files that seeds name, and the two
    token lists are compared on the diagonals that they name, in Arrow batches."""
    windows = token_windows(stream, k)
    first = windows.groupBy("lang", "gram").agg(F.min(F.struct("file", "pos")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = windows.withColumn("g", F.struct("lang", "gram"))
    seed = lookup(keyed, first.select(F.struct("lang", "gram").alias("g"), F.col("f.file").alias("a"), F.col("f.pos").alias("a_pos")), "g").filter("a <> file")
    asked = seed.groupBy("a", F.col("file").alias("b")).agg(F.collect_list(F.struct((F.col("a_pos") - F.col("pos")).alias("d"), "pos")).alias("seeds"))
    ids = F.transform("tags", lambda t: F.xxhash64(t))
    side = lambda s: stream.select(F.col("file").alias(s), ids.alias(f"t{s}"))
    j = asked.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.col("seeds.d").alias("d"), F.col("seeds.pos").alias("p"), "ta", "tb")
    kinds = dict(j.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = zip(*((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in map(batch.column, range(2, 6))))
            owner, found = [], []
            for i in range(batch.num_rows):
                d, pos, ta, tb = (f[o[i] : o[i + 1]] for f, o in zip(flat, off))
                for x in np.unique(d):
                    lo, hi = max(0, -int(x)), min(len(tb), len(ta) - int(x))
                    same = np.zeros(hi - lo + 2, np.int8)
                    same[1:-1] = ta[lo + x : hi + x] == tb[lo:hi]
                    edge = np.flatnonzero(np.diff(same))
                    start, end = edge[::2] + lo, edge[1::2] + lo
                    at = np.searchsorted(start, pos[d == x], "right") - 1
                    for r in np.unique(at[at >= 0]):
                        if end[r] - start[r] >= least:
                            owner.append(i)
                            found.append((int(start[r] + x), int(start[r]), int(end[r] - start[r])))
            at = pa.array(owner, pa.int64())
            cols = [pa.array([f[c] for f in found], pa.int32()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *cols], names=["a", "b", "a_pos", "b_pos", "length"])

    return j.mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, a_pos int, b_pos int, length int")


def token_runs(stream: DataFrame, k: int = TOKEN_K, least: int = TOKEN_LEAST, lines: int = LINE_LEAST) -> DataFrame:
    """(a, b, a_pos, b_pos, tokens, a_from, a_to, b_from, b_to): runs of at least so many
    tokens and lines that compute something, with the lines they cover."""
    stream = cut(stream)
    runs = extended_runs(stream, k, least)
    side = lambda s: stream.select(F.col("file").alias(s), F.col("lines").alias(f"{s}_l"), *([F.col("tags")] if s == "b" else []))
    j = runs.join(side("a"), "a").join(side("b"), "b")
    span = lambda s: F.slice(f"{s}_l", F.col(f"{s}_pos") + 1, F.col("length"))
    j = j.select(
        "a", "b", "a_pos", "b_pos", F.col("length").alias("tokens"), F.slice("tags", F.col("b_pos") + 1, F.col("length")).alias("t"),
        *(f(span(s)).alias(f"{s}_{n}") for s in "ab" for n, f in (("from", F.array_min), ("to", F.array_max))),
    )
    return j.filter(F.exists("t", lambda x: x.isin(*OPERATIONS)) & (F.col("b_to") - F.col("b_from") + 1 >= lines)).drop("t")
