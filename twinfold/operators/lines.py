"""What the copies of a family have in common and where they vary: shared lines,
varying spots, the skeleton of an extraction, and whether a change touches what is
shared. One family is one row with the lines of its members; all is done inside it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .align import lcs_diff

#: Copies beyond the first that vote on a line, and the share of them that must have it.
VOTERS, SHARE = 7, 0.6
#: Varying spots and characters of each that are shown; from SPOTS on a verdict is not given.
SPOTS, SHOWN = 16, 160


def holes(diff: list[tuple[str, str]]) -> int:
    n, inside = 0, False
    for op, _ in diff:
        n += op != "=" and not inside
        inside = op != "="
    return n


def shared_lines(members: list[list[str]]) -> tuple[list[str], int, int] | None:
    """(rank lines, lines that all copies share, varying spots of the first pair);
    None for less than two copies. A rank line is trimmed and shared with the first
    copy by SHARE of the others."""
    if len(members) < 2:
        return None
    first, others = members[0], members[1 : VOTERS + 1]
    votes: dict[str, int] = {}
    survive = [True] * len(first)
    params = 0
    for k, other in enumerate(others):
        diff = lcs_diff(first, other)
        if not k:
            params = holes(diff)
        at, kept, mine = 0, set(), set()
        for op, line in diff:
            if op == "=":
                kept.add(at)
                if line.strip():
                    mine.add(line.strip())
            at += op != "+"
        survive = [s and i in kept for i, s in enumerate(survive)]
        for line in mine:
            votes[line] = votes.get(line, 0) + 1
    need = max(1, -(-len(others) * 6 // 10))
    return sorted(x for x, n in votes.items() if n >= need), sum(survive), params


def _shown(text: str) -> str:
    text = text.strip()
    return text[:SHOWN] + "…" if len(text) > SHOWN else text


def varying_spots(a: list[str], b: list[str], a_start: int = 1, b_start: int = 1) -> list[dict]:
    """The stretches in which two copies differ: param, first and last line and text
    on either side; at most SPOTS of them."""
    out: list[dict] = []
    i, j, inside = a_start, b_start, False
    for op, line in lcs_diff(a, b):
        if op == "=":
            inside, i, j = False, i + 1, j + 1
            continue
        if not inside:
            if len(out) >= SPOTS:
                break
            inside = True
            out.append({"param": len(out) + 1, "a_from": None, "a_to": None, "b_from": None, "b_to": None, "a_text": "", "b_text": ""})
        spot, side, at = out[-1], "a" if op == "-" else "b", i if op == "-" else j
        spot[f"{side}_from"] = at if spot[f"{side}_from"] is None else spot[f"{side}_from"]
        spot[f"{side}_to"] = at
        if len(spot[f"{side}_text"]) <= SHOWN:
            spot[f"{side}_text"] = (spot[f"{side}_text"] + " " + _shown(line)).strip()
        i, j = i + (op == "-"), j + (op == "+")
    for spot in out:
        spot["a_text"], spot["b_text"] = _shown(spot["a_text"]), _shown(spot["b_text"])
    return out


def touches_shared(lines: list[str], sibling: list[str], start: int, end: int, changed: list[tuple[int, int]], exact: bool = False) -> bool | None:
    """Whether a change to a member (lines start..end) touches lines that it shares
    with its sibling; None where too much varies to tell. An empty range is an
    insertion and counts where it stands inside the member but outside what varies."""
    if exact:
        return True
    spots = varying_spots(lines, sibling, start)
    if len(spots) >= SPOTS:
        return None
    varying = [(s["a_from"], s["a_to"]) for s in spots if s["a_from"] is not None]
    for a, z in changed:
        lo, hi = max(a, start), min(z, end)
        if lo > hi:
            if a > start and z < end and not any(z >= x and a <= y for x, y in varying):
                return True
        elif any(not any(x <= line <= y for x, y in varying) for line in range(lo, hi + 1)):
            return True
    return False


def family_lines(families: DataFrame) -> DataFrame:
    """(family, rank_lines, display, params) of (family, members ARRAY<ARRAY<STRING>>)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, members in zip(f.family, f.members):
                got = shared_lines([list(m) for m in members if m is not None])
                if got:
                    rows.append((key, *got))
            yield pd.DataFrame(rows, columns=["family", "rank_lines", "display", "params"])

    return families.select("family", "members").mapInPandas(run, f"family {dict(families.dtypes)['family']}, rank_lines array<string>, display int, params int")


def pair_spots(pairs: DataFrame) -> DataFrame:
    """(a, b, param, a_from, a_to, b_from, b_to, a_text, b_text) of (a, b, a_lines,
    b_lines)."""
    fields = ["param", "a_from", "a_to", "b_from", "b_to", "a_text", "b_text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(a, b, *(s[k] for k in fields)) for a, b, x, y in zip(f.a, f.b, f.a_lines, f.b_lines) for s in varying_spots(list(x), list(y))]
            out = pd.DataFrame(rows, columns=["a", "b", *fields])
            yield out.astype({k: "Int32" for k in fields[:5]})

    k = dict(pairs.dtypes)
    return pairs.select("a", "b", "a_lines", "b_lines").mapInPandas(run,
        f"a {k['a']}, b {k['b']}, param int, a_from int, a_to int, b_from int, b_to int, a_text string, b_text string")
