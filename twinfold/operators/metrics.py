"""Evaluation: ranking metrics, pair precision and recall, fingerprint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scale import prefix_sums


def ranking(scored: DataFrame) -> DataFrame:
    """(auc, average_precision, positives, negatives) of (score, good BOOLEAN).
    AUC counts ties half; in the precision tied rows come in together."""
    v = scored.filter("score IS NOT NULL AND good IS NOT NULL").groupBy((-F.col("score")).alias("x")).agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    c = prefix_sums(v, [], ["x"], ["g", "b"])
    one = c.agg(
        F.sum("g").alias("positives"), F.sum("b").alias("negatives"), F.sum(F.col("b") * (F.col("cum_g") - F.col("g") / 2)).alias("u"),
            F.sum(F.col("g") * F.col("cum_g") / (F.col("cum_g") + F.col("cum_b"))).alias("p")
    )
    return one.select(F.round(F.col("u") / (F.col("positives") * F.col("negatives")), 6).alias("auc"),
        F.round(F.col("p") / F.col("positives"), 6).alias("average_precision"), "positives", "negatives")


def recall_at(scored: DataFrame, precision: float) -> DataFrame:
    """(precision, recall): the best recall at which the precision still holds."""
    v = scored.filter("score IS NOT NULL AND good IS NOT NULL").groupBy((-F.col("score")).alias("x")).agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    c = prefix_sums(v, [], ["x"], ["g", "b"])
    ok = F.when(F.col("cum_g") / (F.col("cum_g") + F.col("cum_b")) >= precision, F.col("cum_g")).otherwise(0)
    return c.agg(F.max(ok).alias("k"), F.sum("g").alias("n")).select(F.lit(precision).alias("precision"),
        F.round(F.coalesce(F.col("k") / F.col("n"), F.lit(0.0)), 6).alias("recall"))


def pair_scores(found: DataFrame, gold: DataFrame, by: str | None = None) -> DataFrame:
    """Precision, recall and F1 of found pairs (a, b) against gold pairs (a, b[, by])."""
    order = lambda d: d.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    f = order(found).select("x", "y").distinct().withColumn("f", F.lit(1))
    keys = [by] if by else []
    g = order(gold).select("x", "y", *keys).distinct().withColumn("g", F.lit(1))
    j = f.join(g, ["x", "y"], "full")
    agg = (j.groupBy(*keys) if keys else j.groupBy()).agg(F.count("f").alias("found"), F.count("g").alias("gold"),
        F.sum(F.when(F.col("f").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0)).alias("hits"))
    p, r = F.col("hits") / F.when(F.col("found") > 0, F.col("found")), F.col("hits") / F.when(F.col("gold") > 0, F.col("gold"))
    return agg.select(*keys, "found", "gold", "hits", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(2 * p * r / F.when(p + r > 0, p + r), 6).alias("f1"))


def held_pairs(found: DataFrame, a: DataFrame, b: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 of found pairs (a, b) against groups, given as their
    members by either side (family_id, a) and (family_id, b), and the number of pairs
    in all groups, one row (gold). hits: found pairs that some group holds; held: how
    often groups hold one. Only found pairs are joined, no group is expanded."""
    met = found.join(a, "a").join(b, ["family_id", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    n = found.agg(F.count(F.lit(1)).alias("found")).crossJoin(gold).crossJoin(met.agg(F.count(F.lit(1)).alias("hits"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("held")))  # one row each
    p, r = F.col("hits") / F.when(F.col("found") > 0, F.col("found")), F.col("held") / F.when(F.col("gold") > 0, F.col("gold"))
    return n.select("found", "gold", "hits", "held", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(2 * p * r / F.when(p + r > 0, p + r), 6).alias("f1"))


def soundness(rows: DataFrame) -> DataFrame:
    """(fp, n, violations) of (id, fp, behaviour): rows whose behaviour differs from
    that of the first row with the same fingerprint."""
    first = rows.groupBy("fp").agg(F.min_by("behaviour", "id").alias("b0"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(first, "fp").groupBy("fp").agg(F.first("n").alias("n"), F.sum((F.col("behaviour") != F.col("b0")).cast("long")).alias("violations"))


def completeness(rows: DataFrame) -> DataFrame:
    """(behaviours, pairs, met): pairs of equal behaviour and those of them with
    equal fingerprints, counted as k (k - 1) / 2 per group."""
    pairs = lambda c: c * (c - 1) / 2
    two = rows.groupBy("behaviour", "fp").agg(F.count(F.lit(1)).alias("k"))
    per = two.groupBy("behaviour").agg(F.sum("k").alias("n"), F.sum(pairs(F.col("k"))).alias("met"))
    return per.agg(F.count(F.lit(1)).alias("behaviours"), F.sum(pairs(F.col("n"))).cast("long").alias("pairs"), F.sum("met").cast("long").alias("met"))


def precision_at(ranked: DataFrame, k: int, group: str) -> DataFrame:
    """(group, precision) over the first k rows by rank of each group of (rank, good)."""
    w = Window.partitionBy(group).orderBy("rank")
    return ranked.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy(group).agg(F.round(F.avg(F.col("good").cast("double")), 6).alias("precision"))


def match_pairs(edges: DataFrame) -> DataFrame:
    """Maximum-weight one-to-one matching per component of (component, p, g,
    weight); each component is one small assignment problem."""

    def solve(f):
        import pandas as pd

        ps, gs = sorted(set(f.p)), sorted(set(f.g))
        w = {(p, g): x for p, g, x in zip(f.p, f.g, f.weight)}
        out = _assign(ps, gs, w)
        return pd.DataFrame([(f.component.iloc[0], p, g, w[p, g]) for p, g in out], columns=["component", "p", "g", "weight"])

    k = dict(edges.dtypes)
    return edges.groupBy("component").applyInPandas(solve, f"component {k['component']}, p {k['p']}, g {k['g']}, weight double")


def _assign(ps: list, gs: list, w: dict) -> list[tuple]:
    """Successive best augmenting paths (Bellman-Ford), exact for maximum weight."""
    mate_p: dict = {}
    mate_g: dict = {}
    while True:
        dist = {("p", p): 0.0 for p in ps if p not in mate_p}
        back: dict = {}
        for _ in range(len(ps) + len(gs)):
            changed = False
            for (p, g), x in w.items():
                if mate_p.get(p) != g and ("p", p) in dist and dist["p", p] + x > dist.get(("g", g), float("-inf")) + 1e-12:
                    dist["g", g] = dist["p", p] + x
                    back["g", g] = p
                    changed = True
            for g, p in mate_g.items():
                if ("g", g) in dist and dist["g", g] - w[p, g] > dist.get(("p", p), float("-inf")) + 1e-12:
                    dist["p", p] = dist["g", g] - w[p, g]
                    back["p", p] = g
                    changed = True
            if not changed:
                break
        free = [(dist["g", g], g) for g in gs if g not in mate_g and ("g", g) in dist]
        if not free or max(free, key=lambda t: t[0])[0] <= 1e-12:
            return sorted(mate_p.items())
        g = max(free, key=lambda t: t[0])[1]
        while True:
            p = back["g", g]
            nxt = mate_p.get(p)
            mate_p[p], mate_g[g] = g, p
            if nxt is None:
                break
            g = nxt
