"""Features of Python units for the code channels: values, anchors, returned values,
guards, literals and the order of constructs, from the syntax tree.

Names are blind: a value is the hash of an expression with every name replaced by
one sign, so copies with renamed variables agree. A unit is a function, a method, a
class, or a block: a loop, a `try`, or an `if` that holds a block."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring
from .align import ransac_offset
from .anchors import nested, rare_anchor_pairs, value_classes
from .scale import spread
from .similarity import multiset_jaccard

#: Places of a file that a unit number leaves room for.
PLACES = 1_000_000
#: Nodes of an anchor and of a value; nodes of a block at most, of a class at most.
ANCHOR, VALUE, BLOCK_NODES, CLASS_NODES = 20, 3, 160, 8000

SCHEMA = (
    "unit_id bigint, file_id bigint, path string, kind string, name string, start_line int, end_line int, token_count int, shape bigint, value array<bigint>, shapes array<bigint>,"
    " anchors array<struct<hash:bigint,weight:int,line_start:int,line_end:int>>, returns array<bigint>, cond_sinks array<bigint>, calls array<string>,"
    " literals array<struct<kind:string,value:string>>, tags array<int>, pure_single_return boolean, exact_safe boolean"
)


#: What only `scored_pairs`, `group_witness` and the like read: most of the bytes and of the time.
HEAVY = ("shape", "shapes", "literals", "tags")


def units_of(src: str, slim: bool = False) -> list[tuple]:
    """Units of a file in the order of SCHEMA from `kind` on, without HEAVY if `slim`;
    none if it does not parse. A sub-tree is a run of the nodes in the order of the
    text, so what a unit holds is a slice of what was found once for the whole file."""
    import ast
    from bisect import bisect_left

    import xxhash

    h = lambda s: xxhash.xxh64_intdigest(s) >> 1
    try:
        root = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    blocks = (ast.For, ast.AsyncFor, ast.While, ast.Try, ast.If, ast.With)
    units = {*functions, ast.ClassDef, ast.For, ast.AsyncFor, ast.While, ast.Try}
    unsafe_kinds = (ast.Yield, ast.YieldFrom, ast.Await, ast.Global, ast.Nonlocal, ast.Delete)
    order, count, methods, unit_at, shapes = [], [], set(), [], []
    known: dict[str, tuple[int, str]] = {}  # each text is hashed once
    fields: dict[type, tuple[str, ...]] = {ast.Constant: ()}  # where children can stand; the value of a constant is none
    todo = [root]
    while todo:
        x = todo.pop()
        t = x.__class__
        kids = []
        if t not in fields:
            fields[t] = x._fields
        for f in fields[t]:
            v = getattr(x, f, None)
            if v.__class__ is list:
                kids += [k for k in v if isinstance(k, ast.AST)]
            elif isinstance(v, ast.AST):
                kids.append(v)
        if t is ast.ClassDef:
            methods.update(id(k) for k in kids)
        if t in units or t is ast.If and any(isinstance(k, blocks) for k in kids):
            unit_at.append(len(order))
        if not slim:
            s = t.__name__ + "(" + ",".join([k.__class__.__name__ for k in kids]) + ")"
            if s not in known:
                known[s] = (v := h(s)), str(v)
            shapes.append(known[s][0])
            count.append(len(kids))
            order.append(x)
        elif t is ast.Name:  # its child is a leaf
            order += (x, kids[0])
            count += (1, 0)
            continue
        else:
            order.append(x)
            count.append(len(kids))
        kids.reverse()
        todo += kids
    n = len(order)
    weight, full, blind = [1] * n, [0] * n, [0] * n
    said, said_blind = [""] * n, [""] * n
    for i in range(n - 1, -1, -1):
        x = order[i]
        t = x.__class__.__name__
        exact = t
        if t == "Constant":
            exact = f"{t}:{type(x.value).__name__}:{x.value!r}"
        elif t == "Attribute":
            exact = t = f"{t}.{x.attr}"
        if not count[i]:
            s, s_blind = exact + "()", t + "()"
        else:
            k, own = i + 1, []
            for _ in range(count[i]):
                own.append(k)
                k += weight[k]
            weight[i] = k - i
            s = exact + "(" + ",".join([said[k] for k in own]) + ")"
            s_blind = None if slim else t + "(" + ",".join([said_blind[k] for k in own]) + ")"
        if s not in known:
            known[s] = (v := h(s)), str(v)
        full[i], said[i] = known[s]
        if not slim:
            if s_blind not in known:
                known[s_blind] = (v := h(s_blind)), str(v)
            blind[i], said_blind[i] = known[s_blind]
    at = {k: [] for k in ("value", "anchor", "return", "sink", "call", "literal", "unsafe")}
    found = {k: [] for k in at}

    def note(kind: str, i: int, what) -> None:
        at[kind].append(i)
        found[kind].append(what)

    leaf = {t for t in {x.__class__ for x in order} if issubclass(t, (ast.Name, ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop, ast.arg))}
    for i, x in enumerate(order):
        t = x.__class__
        if t in leaf:
            continue
        w = weight[i]
        if w >= VALUE and isinstance(x, ast.expr):
            note("value", i, full[i])
        if w >= ANCHOR and isinstance(x, (ast.expr, ast.stmt)):
            note("anchor", i, (full[i], w, x.lineno, x.end_lineno or x.lineno))
        if t is ast.Return:
            note("return", i, None if x.value is None else full[i + 1])  # the value is the only child
        elif t is ast.If or t is ast.While:
            note("sink", i, full[i + 1])  # the test is the first child
        elif t is ast.Call:
            if isinstance(x.func, (ast.Name, ast.Attribute)):
                note("call", i, x.func.id if isinstance(x.func, ast.Name) else x.func.attr)
        elif t is ast.Constant:
            if not slim:
                note("literal", i, (type(x.value).__name__, repr(x.value)))
        elif isinstance(x, unsafe_kinds):
            note("unsafe", i, True)
    kinds = {t: h(t.__name__) & 0x7FFFFFFF for t in {type(x) for x in order}} if not slim else {}
    plain = lambda s: isinstance(s, (ast.Assign, ast.Return)) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)
    out = []
    for i in unit_at:
        x, w = order[i], weight[i]
        if isinstance(x, functions):
            kind, name = ("Method" if id(x) in methods else "Function"), x.name
        elif isinstance(x, ast.ClassDef):
            if w > CLASS_NODES:
                continue
            kind, name = "Class", x.name
        else:
            if w > BLOCK_NODES:
                continue
            kind, name = "Block", None
        inside = lambda k, first=i: found[k][bisect_left(at[k], first) : bisect_left(at[k], i + w)]  # noqa: B023, E731
        own = inside("return")
        pure = isinstance(x, functions) and len(own) == 1 and own[0] is not None and all(map(plain, x.body))
        parts = (sorted(inside("value")), inside("anchor", i + 1), sorted(v for v in own if v is not None), sorted(inside("sink")), sorted(set(inside("call"))))
        head, tail = (kind, name, x.lineno, x.end_lineno or x.lineno, w), (pure, not inside("unsafe"))
        out.append((*head, *parts, *tail) if slim else (*head, blind[i], parts[0], sorted(shapes[i : i + w]), *parts[1:], inside("literal"),
            [kinds[type(y)] for y in order[i : i + w]], *tail))
    return out


def python_features(files: DataFrame, slim: bool = False) -> DataFrame:
    """The units of the Python files that parse, numbered file_id * PLACES + place;
    without the columns of HEAVY if `slim`."""
    src = files.filter("path LIKE '%.py' OR path LIKE '%.pyi'").select("file_id", "path", "src")
    schema = re.sub(rf" ({'|'.join(HEAVY)}) (array<struct<[^>]*>>|[^,]*),", "", SCHEMA) if slim else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, text = pa.int64(), pa.string()
        many = pa.list_
        types = {
            "unit_id": long, "file_id": long, "path": text, "kind": text, "name": text, "start_line": pa.int32(), "end_line": pa.int32(), "token_count": pa.int32(),
            "shape": long, "value": many(long), "shapes": many(long), "anchors": many(pa.struct([("hash", long), ("weight", pa.int32()), ("line_start", pa.int32()),
            ("line_end", pa.int32())])), "returns": many(long), "cond_sinks": many(long), "calls": many(text), "literals": many(pa.struct([("kind", text), ("value", text)])),
            "tags": many(pa.int32()), "pure_single_return": pa.bool_(), "exact_safe": pa.bool_(),
        }
        types = {k: v for k, v in types.items() if not (slim and k in HEAVY)}
        for b in (x.slice(k, 200) for x in batches for k in range(0, x.num_rows, 200)):  # few rows at once: the garbage collector walks all of them
            rows = [(i * PLACES + k, i, p, *u) for i, p, s in zip(*(c.to_pylist() for c in b.columns)) for k, u in enumerate(units_of(s or "", slim))]
            cols = zip(*rows) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values())], names=list(types))

    return spread(src).mapInArrow(run, schema)


def with_called_returns(units: DataFrame) -> DataFrame:
    """`units` with called_helper_returns: the values that helpers of the same file
    return which a unit calls by name."""
    helpers = units.filter("pure_single_return AND name IS NOT NULL").select("file_id", F.col("name").alias("call"), F.explode("returns").alias("r")).distinct()
    called = units.select("unit_id", "file_id", F.explode("calls").alias("call")).join(helpers,
        ["file_id", "call"]).groupBy("unit_id").agg(F.array_sort(F.collect_set("r")).alias("called_helper_returns"))
    return units.join(called, "unit_id", "left").withColumn("used_length_contract", F.array_contains("calls", "len"))


def offset_ratio(a, b):
    """Share of constructs in step under the best offset, Arrow batch by batch."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ransac_offset(list(p), list(q)) for p, q in zip(x, y)])

    return F.pandas_udf(run, "double")(a, b)


def scored_pairs(units: DataFrame) -> DataFrame:
    """(a, b, exact, near, strict, score): pairs that share a rare anchor or all their
    values, scored by every channel; spans inside each other are no pair."""
    star = value_classes(units, scoring.EXACT_VALUES).filter("unit_id <> class_id").select(F.col("class_id").alias("a"), F.col("unit_id").alias("b"),
        F.lit(None).cast("int").alias("anchor"))
    cand = rare_anchor_pairs(units).select("a", "b", F.col("weight").alias("anchor")).unionByName(star).groupBy("a", "b").agg(F.max("anchor").alias("anchor"))
    cols = ("path", "start_line", "end_line", "value", "shapes", "literals", "returns", "tags", "exact_safe")
    side = lambda k: units.select(F.col("unit_id").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in cols))
    j = cand.join(side("a"), "a").join(side("b"), "b")
    j = j.filter(~nested(*(F.col(f"{k}_{c}") for k in "ab" for c in ("path", "start_line", "end_line"))))
    vj, sj = multiset_jaccard(F.col("a_value"), F.col("b_value")), multiset_jaccard(F.col("a_shapes"), F.col("b_shapes"))
    j = j.withColumn("vj", vj).withColumn("sj", sj).withColumn("rj", offset_ratio(F.col("a_tags"), F.col("b_tags")))
    exact = scoring.exact(F.col("a_value"), F.col("b_value"), F.col("a_exact_safe"), F.col("b_exact_safe"))
    near = scoring.near(F.col("vj"), F.col("sj"), F.col("rj"), F.least(F.size("a_value"), F.size("b_value")), F.col("anchor"))
    gates = lambda s: scoring.return_gate(scoring.data_gate(s, F.col("a_value"), F.col("a_literals"), F.col("b_value"), F.col("b_literals")),
        F.col("a_returns"), F.col("b_returns"))
    strict = scoring.strict(F.col("vj"), F.col("sj"), F.col("rj"), gates)
    return j.select("a", "b", exact.alias("exact"), near.alias("near"), strict.alias("strict"), scoring.channel_max(exact, near, strict).alias("score"))
