"""Problem 2: one group identifier for everything linked directly or indirectly.

Method: shrink the link graph, solve what is left, give labels back.

* `shrink` removes every vertex of degree one or two in one go. Chains of such
  vertices are walked from both ends by list ranking (pointer doubling), so a
  chain of a million links takes twenty rounds, not a million. A chain between
  two branch vertices becomes one link between them; a chain that ends in a leaf
  hangs off its branch vertex; a component that is a bare path or ring is done.
* It is repeated while it removes something worth a round. A reduced core of at
  most CORE links, a constant, is then solved by one task with union-find; a
  larger one by `contract`: each vertex hooks onto its smallest neighbour, the
  hooks are followed to their roots by pointer doubling, and the links are redrawn
  between roots, which at least halves the vertices; then it goes on.
* Each removal is a row (v, parent); labels go back over these tables in reverse
  order.

Vertices are numbered by a 64-bit hash of their path, so links are numbered where
they are read, without a join or a sort. While the paths are listed it is checked
that no two share a number; should two do, dense ids are used instead.

Hot vertices: degrees and minima are aggregated map-side; joins on a vertex that
may hold many rows go through `scale.lookup`, which splits hot keys. Links of
removed vertices are taken away by an anti-join on the whole link, never on one
end. Nothing is collected; the driver sees only row counts, which are taken while
rows are written.

Defined results: a null side links nothing; a link of a path with itself and
repeated links change nothing; a vertex without links is its own group; empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import cut, cut_counted, dense_ids, lookup, release

#: Links of a core that one task solves.
CORE = 250_000
#: Share of the links from which another round of stripping is worth it.
WORTH = 0.05


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def rank_lists(heads: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(lists followed to their ends by pointer doubling, the tables behind them).

    heads: (v, to, cur, head, mn, open). A row stands at v and heads for `to`; it
    has come as far as `cur`; while `open` the walk goes on at row (cur, head), and
    `mn` is the smallest vertex passed. As long as some list has not been walked to
    its end a row closes every round; when none does, only rings are left, and they
    are done once no minimum changes. Closed rows are written once."""
    is_open = {"left": F.sum(F.col("open").cast("long"))}
    walk, state = cut_counted(heads, **is_open)
    parts, tables, left = [walk], [walk], state["left"]
    while left:
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        nxt = rows.select(F.col("v").alias("cur"), F.col("to").alias("head"), F.col("cur").alias("cur2"), F.col("head").alias("head2"),
            F.col("mn").alias("mn2"), F.col("open").alias("open2"))
        on = parts[-1].filter("open").join(nxt, ["cur", "head"])
        moved = on.select("v", "to", F.col("cur2").alias("cur"), F.col("head2").alias("head"), F.least("mn", "mn2").alias("mn"),
            F.col("open2").alias("open"), (F.col("mn2") < F.col("mn")).alias("less"))
        walk, state = cut_counted(moved, **is_open, less=F.sum(F.col("less").cast("long")))
        tables.append(walk)
        parts[-1] = parts[-1].filter("NOT open")
        parts.append(walk.drop("less"))
        if state["left"] == left and not state["less"]:
            break
        left = state["left"]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows, tables


def shrink(edges: DataFrame, size: int) -> tuple[DataFrame, int, DataFrame | None]:
    """(links between branch vertices, their number, removed (v, parent)); no
    removal if fewer than WORTH of the `size` links would go."""
    deg = _both(edges).groupBy("u").agg(F.count(F.lit(1)).alias("deg"), F.min("v").alias("n1"), F.max("v").alias("n2"))
    thin, state = cut_counted(deg.filter("deg <= 2"), two=F.sum((F.col("deg") == 2).cast("long")))
    if state["n"] < WORTH * size:  # hardly anything to strip: the core is left
        release(thin)
        return edges, size, None
    walks = state["n"] + state["two"]
    one = thin.select(F.col("u").alias("v"), F.col("n1").alias("to"))
    two = thin.filter("deg = 2").select(F.col("u").alias("v"), F.col("n2").alias("to"))
    ahead = thin.select(F.col("u").alias("to"), "deg", "n1", "n2")
    heads = lookup(one.unionByName(two), ahead, "to", "left", rows=walks).select(  # a branch vertex may be the next of very many
        "v",
        "to",
        F.col("to").alias("cur"),
        F.when(F.col("n1") == F.col("v"), F.col("n2")).otherwise(F.col("n1")).alias("head"),
        F.col("v").alias("mn"),
        (F.coalesce(F.col("deg"), F.lit(0)) == 2).alias("open"),
    )
    walk, tables = rank_lists(heads)
    leaf = thin.filter("deg = 1").select(F.col("u").alias("cur"), F.lit(True).alias("leaf"))
    ends = lookup(walk.select("v", "cur", "mn", "open"), leaf, "cur", "left", rows=walks).select("v", "cur", "mn", "open", F.coalesce("leaf", F.lit(False)).alias("leaf"))
    # a vertex has one row (leaf) or two (inner); a branch end wins over leaf ends
    branch = F.when(~F.col("open") & ~F.col("leaf"), F.col("cur"))
    low = F.when(F.col("open") | ~F.col("leaf"), F.col("mn")).otherwise(F.least("mn", "cur"))
    per = cut(ends.groupBy("v").agg(F.min(branch).alias("b1"), F.max(branch).alias("b2"), F.count(branch).alias("nb"), F.min(low).alias("low")))
    gone = per.select("v", F.coalesce("b1", "low").alias("parent"))
    bridges = per.filter("nb = 2 AND b1 <> b2").select(F.least("b1", "b2").alias("u"), F.greatest("b1", "b2").alias("v"))
    dead = one.unionByName(two).select(F.least("v", "to").alias("u"), F.greatest("v", "to").alias("v")).distinct()
    kept, state = cut_counted(edges.join(dead, ["u", "v"], "left_anti").unionByName(bridges).distinct())
    release(thin, edges, *tables)
    return kept, state["n"], gone


def contract(edges: DataFrame, size: int) -> tuple[DataFrame, int, DataFrame]:
    """(links between the roots of the hooked trees, their number, (v, parent) of
    hooked vertices)."""
    hook, state = cut_counted(_both(edges).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("parent")))
    n = state["n"]
    while True:
        up = hook.select(F.col("v").alias("parent"), F.col("parent").alias("top"))
        step = lookup(hook.select("v", "parent"), up, "parent", rows=n).select("v", F.col("top").alias("parent"),
            (F.col("top") != F.col("parent")).cast("long").alias("moved"))
        nxt, state = cut_counted(step, moved=F.sum("moved"))
        release(hook)
        hook = nxt
        if not state["moved"]:
            break
    left = lookup(edges, hook.select(F.col("v").alias("u"), F.col("parent").alias("ru")), "u", rows=size)
    both = lookup(left.select("v", "ru"), hook.select("v", F.col("parent").alias("rv")), "v", rows=size)
    redrawn, state = cut_counted(both.filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
    release(edges)
    return redrawn, state["n"], hook.filter("v <> parent").select("v", "parent")


def solve(edges: DataFrame) -> DataFrame:
    """(v, parent) of all vertices of at most CORE links but one per component, by
    union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (r := up.setdefault(root, root)) != root:
                root = r
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(x), find(y)
                up[max(x, y)] = min(x, y)
        rows = [(v, r) for v in up if (r := find(v)) != v]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["v", "parent"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "v long, parent long")


def components(edges: DataFrame, core: int = CORE) -> DataFrame:
    """(v, label) for the vertices of `edges` (u, v BIGINT); label is one vertex of
    the component, which itself may have no row."""
    ends = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges, state = cut_counted(ends)
    steps: list[DataFrame] = []
    left = state["n"]
    while left:
        edges, left, gone = shrink(edges, left)
        if gone is not None:
            steps.append(gone)
            if left > core:
                continue
        if left:
            if left <= core:
                steps.append(cut(solve(edges)))
                break
            edges, left, gone = contract(edges, left)
            steps.append(gone)
    labels = edges.sparkSession.createDataFrame([], "v long, root long")
    for k, step in enumerate(reversed(steps)):
        if not k:
            labels = step.select("v", F.col("parent").alias("root"))
            continue
        back = lookup(step, labels.select(F.col("v").alias("parent"), "root"), "parent", "left").select("v", F.coalesce("root", "parent").alias("root"))
        labels = cut(labels.unionByName(back))
    return labels.select("v", F.col("root").alias("label"))


def number(path: Column) -> Column:
    return F.xxhash64(path)


def group_paths(vertices: DataFrame, links: DataFrame, core: int = CORE) -> DataFrame:
    """(group_path, path): `vertices` (path) grouped by `links` (a, b), all STRING.
    The name of a group is its smallest path in code point order."""
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    asked = vertices.filter("path IS NOT NULL").select("path", F.lit(True).alias("asked")).distinct()
    ends = links.select(F.explode(F.array("a", "b")).alias("path")).distinct().withColumn("asked", F.lit(False))
    every = asked.unionByName(ends).withColumn("id", number(F.col("path")))
    ids, state = cut_counted(every.groupBy("id").agg(F.min("path").alias("path"), F.max("path").alias("other"), F.max("asked").alias("asked")),
        twins=F.sum((F.col("path") != F.col("other")).cast("long")))
    n = state["n"]
    if state["twins"]:  # two paths with one number
        release(ids)
        ids = cut(dense_ids(every, ["path"]).join(asked, "path", "left").select("id", "path", F.coalesce("asked", F.lit(False)).alias("asked")))
        e = lookup(links, ids.select(F.col("path").alias("a"), F.col("id").alias("u")), "a")
        e = lookup(e.select("b", "u"), ids.select(F.col("path").alias("b"), F.col("id").alias("v")), "b").select("u", "v")
    else:
        e = links.select(number(F.col("a")).alias("u"), number(F.col("b")).alias("v"))
    comp = components(e, core)
    named = cut(ids.join(comp.select(F.col("v").alias("id"), "label"), "id", "left").select("path", "asked", F.coalesce("label", "id").alias("label")))
    release(ids)
    names = named.groupBy("label").agg(F.min("path").alias("group_path"))
    return lookup(named.filter("asked").select("path", "label"), names, "label", rows=n).select("group_path", "path")


def md_links(witness_refs: DataFrame, families: DataFrame) -> DataFrame:
    """(a, b) from witness rows and from family members. The members of a family
    are tied to its smallest path, so a family of n gives n - 1 links."""
    pairs = witness_refs.select(F.col("a_path").alias("a"), F.col("b_path").alias("b"))
    paths = families.select(F.expr("filter(transform(members, m -> m.path), p -> p IS NOT NULL)").alias("p")).filter("size(p) > 1")
    star = paths.select(F.array_min("p").alias("a"), F.explode("p").alias("b"))
    return pairs.unionByName(star)


def p2_found(spark, sf_dir: str) -> DataFrame:
    from ..tables import table

    links = md_links(table(spark, sf_dir, "witness_refs"), table(spark, sf_dir, "families"))
    return group_paths(table(spark, sf_dir, "md_units"), links)


P2_SQL = """WITH RECURSIVE lk AS (SELECT a_path AS a, b_path AS b FROM witness_refs WHERE a_path IS NOT NULL AND b_path IS NOT NULL
UNION SELECT list_min(p), unnest(p) FROM (SELECT list_filter(list_transform(members, lambda m: m.path), lambda x: x IS NOT NULL) AS p FROM families)
  WHERE len(p) > 1),
e AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
cc(v, g) USING KEY (v) AS (SELECT v, v FROM (SELECT a AS v FROM e UNION SELECT path FROM md_units WHERE path IS NOT NULL)
  UNION (SELECT e.b, min(cc.g) FROM cc JOIN e ON e.a = cc.v JOIN recurring.cc AS r ON r.v = e.b WHERE cc.g < r.g GROUP BY e.b))
SELECT DISTINCT g AS group_path, path FROM md_units JOIN cc ON v = path"""
