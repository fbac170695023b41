"""Fingerprints of HTML and CSS that are equal for equal rendering, and the
regions of a page that hold other languages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Named colours and the properties whose box values expand (fixed values, CSS).
_COLOURS = {"white": "#ffffff", "black": "#000000", "red": "#ff0000", "lime": "#00ff00", "blue": "#0000ff", "gray": "#808080", "grey": "#808080",
    "yellow": "#ffff00", "transparent": "#00000000"}
_BOX = {"margin", "padding", "border-width", "border-style", "border-color", "inset"}


def _h(s: str) -> int:
    return xxhash.xxh64_intdigest(s) >> 1


def css_value(prop: str, value: str) -> str:
    """The canonical form of a declaration's value."""
    v = re.sub(r"\s+", " ", value.strip().lower())
    v = re.sub(r"#([0-9a-f])([0-9a-f])([0-9a-f])(?![0-9a-f])", r"#\1\1\2\2\3\3", v)
    v = re.sub(r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", lambda m: "#%02x%02x%02x" % tuple(min(255, int(x)) for x in m.groups()), v)
    v = re.sub(r"(?<![\w.])(\d*)\.(\d*?)0+(?![\d])", lambda m: m[1] + ("." + m[2] if m[2] else ""), v)
    v = re.sub(r"(?<![\w.])0+(?=\.\d)", "", v)
    v = re.sub(r"(?<![\w.#])[-+]?0(?:\.0*)?(?:px|em|rem|pt|cm|mm|in|vh|vw|%)(?!\w)", "0", v)
    words = [_COLOURS.get(w, w) for w in v.split(" ")]
    if prop in _BOX:
        if len(words) == 4 and words[1] == words[3]:
            words = words[:3]
        if len(words) == 3 and words[0] == words[2]:
            words = words[:2]
        if len(words) == 2 and words[0] == words[1]:
            words = words[:1]
    return " ".join(words)


def style_hash(declarations: str) -> int:
    """Of a declaration list: the last of a property wins, the order of properties
    does not matter, unless a shorthand stands with one of its longhands."""
    seen: dict[str, str] = {}
    order = []
    for part in re.split(r";(?![^(]*\))", declarations):
        name, colon, value = part.partition(":")
        if colon and value.strip():
            name = name.strip().lower()
            seen.pop(name, None)
            seen[name] = css_value(name, value)
            order.append(name)
    mixed = any(a != b and b.startswith(a + "-") for a in seen for b in seen)
    items = list(seen.items()) if mixed else sorted(seen.items())
    return _h(("o" if mixed else "u") + ";".join(f"{k}:{v}" for k, v in items))


def css_rules(css: str) -> list[tuple[str, int]]:
    """(context, style hash) per rule; the selector does not count, at-rules around it do."""
    css = re.sub(r"/\*.*?\*/", "", css, flags=re.S)
    out, context, i = [], [], 0
    for m in re.finditer(r"[{}]", css):
        head = css[i : m.start()].strip()
        i = m.end()
        if m.group() == "{":
            context.append(re.sub(r"\s+", " ", head.lower()))
        elif context:
            name = context.pop()
            if head and not name.startswith("@") or head and name.startswith("@font-face"):
                out.append((" ".join(c for c in context if c.startswith("@")), style_hash(head)))
    return out


class _Dom(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = [["#root", "", []]]
        self.hashes: list[int] = []

    def handle_starttag(self, tag, attrs):
        a = []
        for k, v in attrs:
            if k == "class":
                v = " ".join(sorted(set((v or "").split())))
            elif k == "style":
                v = str(style_hash(v or ""))
            a.append(f"{k}={v or ''}")
        self.stack.append([tag, ",".join(sorted(set(a))), []])
        if tag in _VOID:
            self.close_one()

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.stack[1:]):
            while self.stack[-1][0] != tag:
                self.close_one()
            self.close_one()

    def handle_data(self, data):
        t = re.sub(r"\s+", " ", data).strip()
        if t:
            self.stack[-1][2].append(_h("t" + t))

    def close_one(self):
        tag, attrs, kids = self.stack.pop()
        h = _h(f"{tag}[{attrs}]({','.join(map(str, kids))})")
        self.hashes.append(h)
        self.stack[-1][2].append(h)


def dom_hashes(html: str) -> list[int]:
    """Hashes of the page and of every element in it, the page last."""
    p = _Dom()
    p.feed(html)
    p.close()
    while len(p.stack) > 1:
        p.close_one()
    return [*p.hashes, _h(f"page({','.join(map(str, p.stack[0][2]))})")]


def regions(html: str) -> list[tuple[str, int, str]]:
    """(kind, first line, text) of the script and style regions of a page; style
    regions in another style language are left out."""
    out = []
    for m in re.finditer(r"<!--.*?-->|<(script|style)\b([^>]*)>(.*?)</\1\s*>", html, re.S | re.I):
        if not m[1]:
            continue
        lang = re.search(r"\b(?:lang|type)\s*=\s*[\"']?([\w/+-]+)", m[2] or "")
        kind = m[1].lower()
        if kind == "style" and lang and lang[1].lower() not in ("css", "text/css"):
            continue
        if kind == "script" and lang and "json" in lang[1].lower():
            continue
        out.append(("typescript" if kind == "script" and lang and lang[1].lower() in ("ts",
            "typescript") else "javascript" if kind == "script" else "css", html.count("\n", 0, m.start(3)) + 1, m[3]))
    return out


def dom_fingerprint(html: Column) -> Column:
    """The hashes of a page and its elements, Arrow batch by Arrow batch."""

    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda s: None if s is None else dom_hashes(s))

    return F.pandas_udf(run, "array<long>")(html)


def embedded_regions(html: Column) -> Column:
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda s: [] if s is None else [{"kind": k, "line": n, "text": t} for k, n, t in regions(s)])

    return F.pandas_udf(run, "array<struct<kind:string,line:int,text:string>>")(html)
