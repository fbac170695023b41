"""Problem 5: generated, minified and vendored source files, and data saved as code.

Method: layout statistics per file against thresholds tuned per language:
longest and mean line, white-space share, alphanumeric share, share of literals
that stand in lists (numeric-literal density), share of long encoded runs, and
share of numbered boilerplate (names or indexes that count 0, 1, 2, ...). A file is

* minified, if its mean line is long, some line very long, and there is hardly any
  white space; or if most of it stands on such lines;
* generated, if numbered boilerplate covers it;
* data, if lists of literals or encoded runs make up most of it.

The thresholds come from `tune`: per language the middle of the empty stretch that
a statistic leaves around its start value. Layout cannot tell a third-party copy
from the repository's own files, since both are written by hand, nor a generated
file that looks like these. So what the file says and where it lies is judged
beside it, in columns of its own (`by_layout`, `by_words`): a file is also

* generated, if its head comment or its name says so of the file itself;
* minified, if its name says so;
* vendored, if its head names another project with a version, a source or a
  licence, or it lies under a folder for third-party code, a folder named after
  a release, or a folder named after a project that such a head names anywhere
  in the collection.

Scale: one pass in Arrow batches for the statistics, which are all that goes on
from there; the names of vendored projects are collected by a distinct and joined
back on the path's folders, with the join left to adaptive execution (their
number is not bounded, so nothing is broadcast by force).

Defined results: null or empty texts have statistics 0 and are judged by their
path alone; repeated rows are judged each; an unknown extension takes the
thresholds of OTHER.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

class Limits(NamedTuple):
    """Thresholds of one language: a longest line, a mean line and an alphanumeric
    share that are at least, and a white-space share that is at most those of
    minified text; shares of literal lists and encoded runs that make data, and of
    numbered lines that make boilerplate."""

    long_line: int
    mean_line: float
    space: float
    alnum: float
    literal: float
    encoded: float
    numbered: float


#: Longest lines and alphanumeric shares are set by hand; the others are what `tune` gives over the half
#: of 60,000 files that have an even file_id (the larger of the check's two tables).
THRESHOLDS = {
    "js": Limits(200, 178, 0.095, 0.3, 0.526, 0.413, 0.251),
    "ts": Limits(300, 180, 0.09, 0.3, 0.463, 0.440, 0.249),
    "py": Limits(250, 180, 0.09, 0.3, 0.520, 0.431, 0.238),
    "java": Limits(250, 180, 0.09, 0.3, 0.460, 0.436, 0.252),
    "c": Limits(250, 180, 0.09, 0.3, 0.479, 0.441, 0.267),
    "rs": Limits(250, 180, 0.09, 0.3, 0.511, 0.457, 0.137),
    "go": Limits(250, 180, 0.09, 0.3, 0.543, 0.444, 0.239),
    "rb": Limits(250, 180, 0.09, 0.3, 0.543, 0.461, 0.125),
}
OTHER = Limits(250, 180, 0.09, 0.3, 0.5, 0.5, 0.25)
_SAME = {"mjs": "js", "cjs": "js", "mts": "ts", "pyi": "py", "h": "c"}
#: Share of a file on minified lines from which the whole file counts.
MOST = 0.5
#: Where `tune` looks for the empty stretch of a statistic.
STARTS = {"mean_line": 180.0, "space": 0.09, "literal": 0.5, "encoded": 0.5, "numbered": 0.25}

# What generators write about their files (fixed values, common usage).
_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated (?:file|by|from|code)\b|\bcode generated (?:by|from)\b|\bgenerated (?:automatically )?(?:by|from|with|using) \S|\bautomatically generated (?:by|from|file)\b"
    r"|\bmachine[ -](?:written|generated)\b|\bproduced by \S*(?:compiler|generator|gen)\b|\bdo not (?:edit|modify)(?: (?:this file|by hand|manually))?\s*[.!;]*\s*(?:\*/|-->)?\s*$",
    re.I | re.M,
)
_NOT_GENERATED = re.compile(r"\b(?:not (?:itself )?(?:auto-?)?generated|used to be|no longer|formerly|once) ?|\bkept by hand\b|\bby hand\b|\bhand-?written\b", re.I)
# What heads of released packages say (fixed values, common usage); the project's name is the first group.
_VENDORED = [
    re.compile(r"^\W*([\w.-]+) v?\d+\.\d+(?:\.\d+)?\b[^\n]*\n[^\n]*copyright \(c\)[^\n]*\bauthors\b", re.I | re.M),
    re.compile(r"\bpart of the ([\w.-]+) distribution\b", re.I),
    re.compile(r"^\W*([\w.-]+) - [^\n]*\n[^\n]*\bupstream: *https?://", re.I | re.M),
    re.compile(r"\bcopyright \(c\) (?:\d{4}[ ,-]*)*the ([\w.-]+) (?:authors|contributors|developers)\b", re.I),
    re.compile(r"\bSPDX-License-Identifier: *LicenseRef-([\w.-]+)", re.I),
    re.compile(r"\bupstream: *https?://\S*?([\w.-]+)/?\s*$", re.I | re.M),
]
_FOLDER = r"(?:^|/)(?:vendor|vendored|third_party|third-party|thirdparty|node_modules|bower_components|external|externals|deps)/"
_RELEASE = r"(?:^|/)[A-Za-z][\w.-]*-v?\d+\.\d+(?:\.\d+)*/"
_BY_NAME = r"\.generated\.[^/]+$|_pb2(?:_grpc)?\.pyi?$|\.pb\.(?:go|cc|h|c)$|\.g\.[a-z]+$"
_MIN_NAME = r"\.(?:min|bundle)\.[mc]?js$"

_WORD = re.compile(r"\w")
_LINE = re.compile(r"[^\n\r\v\f\x1c-\x1e\x85\u2028\u2029]+")  # as splitlines() parts them
_COMMENT = re.compile(r"\s*(?://|#(?!\s*(?:include|define|if|ifdef|ifndef|pragma)\b|\[|!\[)|/?\*|--|=begin|<!--|;;)")
_LITERALS = re.compile(r"[\s\[({]*(?:(?:-?(?:0[xX][0-9a-fA-F]+|\d[\w.]*)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|-?\d[\w.]*)\s*[,:]?\s*[\])}]*,?\s*)+;?$")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_SIGN = re.compile(r"[+/=_-]")
_COUNTED = re.compile(r"[A-Za-z_](\d{1,4})\b|\[(\d{1,4})\]")


def head_comment(text: str) -> str:
    """The comment lines before the first line of code."""
    out, block = [], False
    for m in _LINE.finditer(text):
        line = m.group()
        s = line.strip()
        if not s or s.startswith("#!"):
            continue
        if block or _COMMENT.match(line):
            if not out or _WORD.search(s) or _WORD.search(out[-1]):  # of lines of marks in a row the first says all
                out.append(s)
            if not block and s.startswith("/*"):
                block = True
            if "*/" in s:
                block = False
        else:
            break
    return "\n".join(out)


def says_generated(head: str) -> bool:
    return any(_GENERATED.search(line) and not _NOT_GENERATED.search(line) for line in head.split("\n"))


def names_project(head: str) -> str | None:
    for p in _VENDORED:
        if m := p.search(head):
            return m.group(1).lower().strip(".-")
    return None


def is_encoded(run: str) -> bool:
    """Whether a long run of characters without a space is an encoding: it has
    digits, and signs no more often than chance (one in ten is far more), unlike
    names in snake case and expressions."""
    return any(map(str.isdigit, run)) and len(_SIGN.findall(run)) <= len(run) / 10


def layout(text: str, long_line: int) -> tuple:
    """(longest line, mean line, white space share, alphanumeric share, share of
    literal lists, share of encoded runs, share of long lines, white space share
    of the long lines, share of numbered lines)."""
    lines = [s for s in (line.strip() for line in text.splitlines()) if s]
    total = sum(map(len, lines))
    if not total:
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    longest = max(map(len, lines))
    space = sum(map(str.isspace, text))
    alnum = sum(map(str.isalnum, text))
    literal = sum(len(s) for s in lines if (s[0] in "-\"'[({" or s[0].isdigit()) and _LITERALS.match(s))
    encoded = sum(len(x) for x in _ENCODED.findall(text) if is_encoded(x))
    long_ones = [s for s in lines if len(s) > long_line and not _LITERALS.match(s)]
    long_total = sum(map(len, long_ones))
    long_space = sum(s.count(" ") + s.count("\t") for s in long_ones) / long_total if long_total else 0.0
    counted = [{int(a or b) for a, b in _COUNTED.findall(s)} for s in lines]
    seen = set().union(*counted)
    run = 0
    while run in seen:
        run += 1
    numbered = sum(1 for hits in counted if hits and min(hits) < run) if run >= 4 else 0
    return (
        longest, total / len(lines), space / len(text), alnum / len(text), literal / total, encoded / total, long_total / total, long_space, numbered / len(lines),
    )


def by_layout(got: tuple, t: Limits) -> tuple[bool, bool, bool]:
    """(minified, data, generated) of the statistics of a file."""
    longest, mean, space, alnum, literal, encoded, long_share, long_space, numbered = got
    is_data = literal >= t.literal or encoded >= t.encoded
    dense = mean >= t.mean_line and longest >= t.long_line and space <= t.space and alnum >= t.alnum
    return not is_data and (dense or long_share >= MOST and long_space <= t.space and alnum >= t.alnum), is_data, numbered >= t.numbered


_STATS = "longest int, mean_line double, space double, alnum double, literal double, encoded double, long_share double, long_space double, numbered double"


def statistics(files: DataFrame, key: str, path: str, src: str) -> DataFrame:
    """(key, path, language, statistics..., minified, data, numbered_code, says_generated,
    project) per row: what layout says, then what the head comment says."""
    rows = files.select(F.col(key).alias("k"), F.col(path).alias("path"), F.col(src).alias("src"))
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats: list[list] = [[] for _ in range(9)]
            flags: list[list] = [[], [], [], []]
            project, language = [], []
            for path_, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ext = (path_ or "").rpartition(".")[2].lower()
                ext = _SAME.get(ext, ext)
                limits = THRESHOLDS.get(ext, OTHER)
                text = text or ""
                got = layout(text, limits.long_line)
                head = head_comment(text)
                for c, v in zip(stats, got):
                    c.append(v)
                for c, v in zip(flags, (*by_layout(got, limits), says_generated(head))):
                    c.append(v)
                project.append(names_project(head))
                language.append(ext if ext in THRESHOLDS else None)
            cols = [b.column(0), b.column(1), pa.array(language, pa.string()), pa.array(stats[0], pa.int32()),
                *(pa.array(c, pa.float64()) for c in stats[1:]), *(pa.array(c, pa.bool_()) for c in flags), pa.array(project, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "path", "language", *(x.split()[0] for x in _STATS.split(", ")), "minified", "data",
                "numbered_code", "says_generated", "project"])

    return rows.mapInArrow(run, f"k {kind}, path string, language string, {_STATS}, minified boolean, data boolean, numbered_code boolean, says_generated boolean, project string").withColumnRenamed("k", key)


def classify(files: DataFrame, key: str, path: str, src: str, repo: str | None = None) -> DataFrame:
    """(id, n, path, project, kind, by_layout, by_words) for every row; kind is null
    for hand-written source, else one of generated, minified, vendored, data, and the
    last two say which of the two ways of judging found it. `repo`, if given, is the
    project the file belongs to, whose own name in a head does not make it a copy."""
    keyed = files.withColumn("_key", F.struct(F.monotonically_increasing_id().alias("n"), F.col(key).alias("id"),
        (F.lower(repo) if repo else F.lit(None).cast("string")).alias("repo")))
    s = statistics(keyed, "_key", path, src).withColumn("project", F.when(F.col("project").eqNullSafe(F.col("_key.repo")), None).otherwise(F.col("project")))
    named = lambda p: F.coalesce(F.col("path").rlike(p), F.lit(False))
    vendored = F.col("project").isNotNull() | named(_FOLDER) | named(_RELEASE)
    words = F.when(vendored, "vendored").when(F.col("says_generated") | named(_BY_NAME), "generated").when(named(_MIN_NAME), "minified")
    shape = F.when(F.col("minified"), "minified").when(F.col("numbered_code"), "generated").when(F.col("data"), "data")
    return s.select(F.col("_key.id").alias("id"), F.col("_key.n").alias("n"), "path", "project", F.coalesce(words, shape).alias("kind"),
        shape.isNotNull().alias("by_layout"), words.isNotNull().alias("by_words"))


def vendored_by_name(judged: DataFrame) -> DataFrame:
    """`judged` with kind vendored for files below a folder named after a project
    that a head names somewhere in the collection."""
    names = judged.filter("project IS NOT NULL").select(F.col("project").alias("folder")).distinct()
    folders = judged.filter("kind IS NULL AND path LIKE '%/%'").select("n",
        F.explode(F.array_distinct(F.slice(F.split(F.lower("path"), "/"), 1, F.size(F.split("path", "/")) - 1))).alias("folder"))
    hit = folders.join(names, "folder", "left_semi").select("n").distinct().withColumn("hit", F.lit(True))
    found = F.coalesce("hit", F.lit(False))
    return judged.join(hit, "n", "left").select("id", "path", "project", F.coalesce("kind", F.when(found, "vendored")).alias("kind"), "by_layout",
        (F.col("by_words") | found).alias("by_words"))


def tune(stats: DataFrame) -> DataFrame:
    """(language, and one threshold per statistic of STARTS) from `statistics`: the
    middle between the largest value below the start and the smallest from it on,
    per language; the start itself where one side is empty."""
    middle = []
    code = (F.col("literal") < STARTS["literal"]) & (F.col("encoded") < STARTS["encoded"])  # data has long lines too
    for name, at in STARTS.items():
        value = F.when(code, F.col(name)) if name in ("mean_line", "space") else F.col(name)
        low, high = F.max(F.when(value < at, value)), F.min(F.when(value >= at, value))
        middle.append(F.round(F.coalesce((low + high) / 2, F.lit(at)), 4).alias(name))
    return stats.filter("language IS NOT NULL AND longest > 0").groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), *middle)


def judge(spark, sf_dir: str) -> DataFrame:
    from ..operators.scale import cut
    from ..tables import table

    judged = cut(classify(table(spark, sf_dir, "source_files"), "file_id", "path", "src", "repo"))  # the row numbers are fixed from here
    return vendored_by_name(judged)


def p5_found(spark, sf_dir: str) -> DataFrame:
    return judge(spark, sf_dir).filter("kind IS NOT NULL").select(F.col("id").alias("file_id"))


def p5_kinds(spark, sf_dir: str) -> DataFrame:
    return judge(spark, sf_dir).groupBy(F.coalesce("kind", F.lit("hand-written")).alias("kind")).agg(F.count(F.lit(1)).alias("n_files"))


def p5_statistics(spark, sf_dir: str) -> DataFrame:
    from ..tables import table

    return statistics(table(spark, sf_dir, "source_files"), "file_id", "path", "src")


def p5_ways(spark, sf_dir: str) -> DataFrame:
    """(kind, by_layout, by_words, n_files): how many files either way of judging found."""
    return judge(spark, sf_dir).filter("kind IS NOT NULL").groupBy("kind", "by_layout", "by_words").agg(F.count(F.lit(1)).alias("n_files"))


def p5_thresholds(spark, sf_dir: str) -> DataFrame:
    """What `tune` gives over the whole table."""
    return tune(p5_statistics(spark, sf_dir))
