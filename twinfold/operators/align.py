"""Alignments of two line lists: local alignment, line diff, skeletons; Arrow
batches in, one row out per accepted pair."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Lines of a text that are aligned are all of them; a byte per cell is kept for the way back.
MATCH, MISS, GAP = 2, -1, -1


def smith_waterman(a: list[str], b: list[str]) -> tuple[int, int, int, int, int]:
    """(matched lines, a from, a to, b from, b to) of the best local alignment, from
    0 and inclusive; diagonal before up before left, the first best cell wins."""
    best, cell = 0, (0, 0)
    step: list[bytearray] = [bytearray(len(b) + 1)]
    above = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row, way = [0] * (len(b) + 1), bytearray(len(b) + 1)
        for j, y in enumerate(b, 1):
            d, u, left = above[j - 1] + (MATCH if x == y else MISS), above[j] + GAP, row[j - 1] + GAP
            v = max(0, d, u, left)
            row[j] = v
            way[j] = 0 if not v else 1 if v == d else 2 if v == u else 3
            if v > best:
                best, cell = v, (i, j)
        step.append(way)
        above = row
    i, j = cell
    hits = []
    while i and j and step[i][j]:
        w = step[i][j]
        if w == 1:
            if a[i - 1] == b[j - 1]:
                hits.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif w == 2:
            i -= 1
        else:
            j -= 1
    if not hits:
        return 0, 0, 0, 0, 0
    xs, ys = [h[0] for h in hits], [h[1] for h in hits]
    return len(hits), min(xs), max(xs), min(ys), max(ys)


def lcs_diff(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """('=', '-', '+') lines of the longest common subsequence; ties delete first.

    The lengths of the common subsequences of all suffixes are kept as one bit per
    cell (a whole row of the table is one integer), whether the lengths of two
    neighbouring columns differ; the bits are all that the walk needs."""
    n, m = len(a), len(b)
    rb = b[::-1]
    where: dict[str, int] = {}
    for j, y in enumerate(rb):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << m) - 1
    row = full  # of reversed prefixes: bit j is 0 where the length grows at column j
    rows = [row]
    for x in reversed(a):
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    rows.reverse()  # rows[i] belongs to the suffix a[i:]
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(("=", a[i]))
            i, j = i + 1, j + 1
            continue
        # length(i + 1, j) >= length(i, j + 1)?  Both lie between length(i + 1, j + 1) and one more.
        low = (1 << (m - j - 1)) - 1
        right = (m - j - 1) - (rows[i] & low).bit_count()
        down = (m - j) - (rows[i + 1] & (low << 1 | 1)).bit_count()
        if down >= right:
            out.append(("-", a[i]))
            i += 1
        else:
            out.append(("+", b[j]))
            j += 1
    return [*out, *(("-", x) for x in a[i:]), *(("+", y) for y in b[j:])]


def kind_of(texts: list[str]) -> str:
    if all(t.lstrip("-").replace(".", "", 1).isdigit() for t in texts):
        return "number"
    if all(t[:1] in "\"'" for t in texts):
        return "string"
    return "name" if all(t.isidentifier() for t in texts) else "text"


def skeleton(members: list[list[str]]) -> tuple[list[str], int, int]:
    """(lines with holes, shared lines, holes): lines of the first member that
    survive the diff with every other stay; what stands between is a hole."""
    if not members:
        return [], 0, 0
    first = members[0]
    keep = set(range(len(first)))
    for other in members[1:]:
        at, same = 0, set()
        for op, _ in lcs_diff(first, other):
            if op == "=":
                same.add(at)
            at += op != "+"
        keep &= same
    out, holes, i = [], 0, 0
    while i < len(first):
        if i in keep:
            out.append(first[i])
            i += 1
            continue
        k = i
        while k < len(first) and k not in keep:
            k += 1
        holes += 1
        out.append(f"<param {holes}: {kind_of([x.strip() for x in first[i:k]])}>")
        i = k
    return out, len(keep), holes


def ransac_offset(a: list[int], b: list[int], votes: int = 8) -> float:
    """Share of tokens in step under the offset with most votes (the largest of
    tied ones); at most `votes` places of b vote per token of a."""
    where: dict[int, list[int]] = {}
    for j, t in enumerate(b):
        where.setdefault(t, []).append(j)
    count: dict[int, int] = {}
    for i, t in enumerate(a):
        for j in where.get(t, ())[:votes]:
            count[j - i] = count.get(j - i, 0) + 1
    if not count:
        return 0.0
    off = max(count, key=lambda k: (count[k], k))
    inliers = sum(1 for i, t in enumerate(a) if 0 <= i + off < len(b) and b[i + off] == t)
    return inliers / max(len(a), len(b))


def line_witness(pairs: DataFrame) -> DataFrame:
    """pairs: (a, b, a_text, b_text) -> (a, b, matched, a_from, a_to, b_from, b_to)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [smith_waterman([x.strip() for x in (s or "").splitlines() if x.strip()],
                [x.strip() for x in (t or "").splitlines() if x.strip()]) for s, t in zip(f.a_text, f.b_text)]
            out = pd.DataFrame(got, columns=["matched", "a_from", "a_to", "b_from", "b_to"], dtype="int32")
            yield pd.concat([f[["a", "b"]].reset_index(drop=True), out], axis=1)

    kinds = dict(pairs.dtypes)
    return pairs.select("a", "b", "a_text", "b_text").mapInPandas(run, f"a {kinds['a']}, b {kinds['b']}, matched int, a_from int, a_to int, b_from int, b_to int")
