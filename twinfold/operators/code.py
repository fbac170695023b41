"""Units of Python source from its syntax tree: features, exact and near clones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import cut, lookup, spread
from .similarity import jaccard_links

_SCHEMA = "file_id long, path string, kind string, name string, start_line int, end_line int, tokens int, tree long, shapes array<long>"
#: Units below these are too small to be worth a comparison.
LINES, TOKENS = 5, 24


def _units(src: str) -> list[tuple]:
    import ast

    import xxhash

    h = lambda s: xxhash.xxh64_intdigest(s) >> 4
    try:
        root = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in ast.walk(root):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        names: dict[str, int] = {}
        shapes: list[int] = []
        count = 0

        def tag(x) -> str:
            t = type(x).__name__
            if isinstance(x, ast.Name):
                return f"{t}{names.setdefault(x.id, len(names))}"
            if isinstance(x, ast.arg):
                return f"{t}{names.setdefault(x.arg, len(names))}"
            if isinstance(x, ast.Constant):
                return f"{t}:{type(x.value).__name__}"
            return t + (f".{x.attr}" if isinstance(x, ast.Attribute) else "")

        # children first, without recursion
        order, todo = [], [node]
        while todo:
            x = todo.pop()
            order.append(x)
            todo += list(ast.iter_child_nodes(x))[::-1]
        tags = {id(x): tag(x) for x in order}
        tree: dict[int, int] = {}
        for x in reversed(order):
            kids = list(ast.iter_child_nodes(x))
            count += 1
            tree[id(x)] = h(tags[id(x)] + "(" + ",".join(str(tree[id(k)]) for k in kids) + ")")
            shapes.append(h(type(x).__name__ + "(" + ",".join(type(k).__name__ for k in kids) + ")"))
        out.append(("Class" if isinstance(node, ast.ClassDef) else "Function", node.name, node.lineno, node.end_lineno or node.lineno, count,
            tree[id(node)], sorted(shapes)))
    return out


def python_units(files: DataFrame) -> DataFrame:
    """Functions and classes of the Python files that parse: place, size, a hash of
    the tree with names numbered by first use, and the multiset of node shapes."""
    src = files.filter("path LIKE '%.py' OR path LIKE '%.pyi'").select("file_id", "path", "src")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, p, *u) for i, p, s in zip(f.file_id, f.path, f.src) for u in _units(s or "")]
            yield pd.DataFrame(rows, columns=["file_id", "path", "kind", "name", "start_line", "end_line", "tokens", "tree", "shapes"])

    return spread(src).mapInPandas(run, _SCHEMA)


def sized(units: DataFrame) -> DataFrame:
    return units.filter((F.col("end_line") - F.col("start_line") + 1 >= LINES) & (F.col("tokens") >= TOKENS))


def exact_clones(units: DataFrame) -> DataFrame:
    """(tree, members, files, first_path, first_line): trees held by several units."""
    g = sized(units).groupBy("tree").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("file_id").alias("files"), F.min(F.struct("path", "start_line")).alias("f"))
    return g.filter("members > 1").select("tree", "members", "files", F.col("f.path").alias("first_path"), F.col("f.start_line").alias("first_line"))


def near_clones(units: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, score): pairs of distinct trees whose shape multisets have a Jaccard of
    `threshold` or more: exact. Trees with equal multisets are one class: each is tied
    to the smallest tree of its class with score 1, and classes are compared by these
    only, so a template with a million instances gives a million rows, not their pairs.
    The k-th repetition of a shape is made an element of its own, a hash of both, so
    the set join applies."""
    trees = cut(sized(units).groupBy("tree").agg(F.min("shapes").alias("shapes")).filter("size(shapes) > 0").withColumn("h", F.sha2(F.to_json(F.struct("shapes")), 256)))
    kinds = trees.groupBy("h").agg(F.min("tree").alias("class_id"), F.min("shapes").alias("shapes"))
    copies = lookup(trees.select("tree", "h"), kinds.select("h", "class_id"), "h").filter("tree <> class_id").select(F.col("class_id").alias("a"),
        F.col("tree").alias("b"), F.lit(1.0).alias("score"))
    tagged = F.transform("shapes", lambda x, i: F.xxhash64(x, i - F.array_position("shapes", x)))  # shapes are sorted
    sets = cut(kinds.select("class_id", F.size("shapes").alias("size"), tagged.alias("grams")))
    links = jaccard_links(sets, threshold - 0.0005).select("a", "b", F.round("jaccard", 3).alias("score"))  # scores are rounded
    return links.filter(F.col("score") >= threshold).unionByName(copies)
