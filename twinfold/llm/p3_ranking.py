"""Problem 3: one ranking from several differently-scaled scores.

Method: outranking net flow. Each score becomes a percentile (mid-rank, so ties
share one), which removes scale and distribution. For each score the preference
of one item over another grows linearly from 0 at a percentile difference of
`indifference` to 1 at `preference`. An item's flow is the mean preference it
has over all others minus the mean they have over it; the net flow is the
weighted mean of the flows.

The mean over all pairs is computed exactly without pairs: with F(t) the number
and S(t) the sum of percentiles up to t,

    sum over j of P(x - x_j) = F(x-p) + [(x-q)(F(x-q) - F(x-p)) - (S(x-q) - S(x-p))] / (p-q)

and likewise for the preference against x. F and S are sorted prefix sums over
the distinct percentiles. Percentiles are kept as whole numbers of half ranks
and S as a decimal, so the sums are exact and do not depend on partitioning.

Scale: one row per distinct (score, value) before anything is sorted, so ties, of
however many rows, cost one row; prefix sums are range-partitioned.

Defined results: a null or NaN score is incomparable: its flow is 0 and it does
not count in the others' flows of that score. Repeated rows count once. Equal
net flows are ordered by id. A table of one row gets net flow 0. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import cut, prefix_sums

#: Percentile differences below the first do not count, above the second count in full.
INDIFFERENCE, PREFERENCE = 0.05, 0.5
#: (score, weight, whether higher is better)
FAMILY_SCORES = (("removable", 1.0, True), ("score", 1.0, True), ("commonness", 1.0, False), ("sem", 1.0, True))
_BIG = "decimal(38,0)"


def net_flow(items: DataFrame, key: str, scores, indifference: float = INDIFFERENCE, preference: float = PREFERENCE) -> DataFrame:
    """(key, flow_<score>..., net_flow, rank) of `items`, unique in `key`."""
    if not 0 <= indifference < preference:
        raise ValueError("0 <= indifference < preference")
    names = [n for n, _, _ in scores]
    long = items.select(
        F.col(key),
        F.explode(F.array(*(F.struct(F.lit(n).alias("s"), (F.col(n) if up else -F.col(n)).cast("double").alias("x")) for n, _, up in scores))).alias("e"),
    ).select(key, "e.s", (F.col("e.x") + 0.0).alias("x"))
    long = cut(long.withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x"))))
    value = long.filter("x IS NOT NULL").groupBy("s", "x").agg(F.count(F.lit(1)).alias("c"))
    ranked = prefix_sums(value, ["s"], ["x"], ["c"])
    # m: the mid-rank in half ranks; 2n half ranks are the whole range
    mids = ranked.select("s", "x", "c", (F.col("cum_c") * 2 - F.col("c")).alias("m"))
    mids = cut(mids)
    n = mids.groupBy("s").agg(F.sum("c").alias("n"))
    n = n.withColumn("q", F.round(F.col("n") * (2 * indifference)).cast("long")).withColumn("p",
        F.greatest(F.round(F.col("n") * (2 * preference)).cast("long"), F.col("q") + 1))
    at = mids.join(F.broadcast(n), "s")  # one row per score
    # every percentile asks for F and S at four points; data rows carry weight, questions none
    data = at.select("s", F.col("m").alias("t"), F.col("c"), (F.col("c").cast(_BIG) * F.col("m")).cast(_BIG).alias("w"))
    asks = at.select("s", F.explode(F.array(F.col("m") - F.col("p"), F.col("m") - F.col("q"), F.col("m") + F.col("q"), F.col("m") + F.col("p"))).alias("t"))
    points = data.unionByName(asks.select("s", "t", F.lit(0).cast("long").alias("c"), F.lit(0).cast(_BIG).alias("w"))).groupBy("s",
        "t").agg(F.sum("c").alias("c"), F.sum("w").cast(_BIG).alias("w"))
    curve = cut(prefix_sums(points, ["s"], ["t"], ["c", "w"]).select("s", "t", F.col("cum_c").cast(_BIG).alias("f"), F.col("cum_w").cast(_BIG).alias("g")))
    four = at.select("s", "x", "m", "n", "q", "p",
        F.posexplode(F.array(F.col("m") - F.col("p"), F.col("m") - F.col("q"), F.col("m") + F.col("q"), F.col("m") + F.col("p"))).alias("i", "t"))
    got = four.join(curve, ["s", "t"]).groupBy("s", "x", "m", "n", "q", "p")
    got = got.agg(*(F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(4) for c in "fg"))
    d = lambda c: F.col(c).cast("double")
    up = d("f0") + ((F.col("m") - F.col("q")) * (F.col("f1") - F.col("f0")) - (F.col("g1") - F.col("g0"))).cast("double") / (d("p") - d("q"))
    down = (d("n") - d("f3")) + ((F.col("g3") - F.col("g2")) - (F.col("m") + F.col("q")) * (F.col("f3") - F.col("f2"))).cast("double") / (d("p") - d("q"))
    flow = got.select("s", "x", F.when(F.col("n") > 1, (up - down) / (d("n") - 1)).otherwise(F.lit(0.0)).alias("flow"))
    total = sum(w for _, w, _ in scores)
    # a hot value is one row here; adaptive execution splits its side of the join
    each = long.join(flow, ["s", "x"], "left")
    wide = each.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col("s") == s, F.col("flow"))), F.lit(0.0)).alias(f"flow_{s}") for s in names))
    net = sum((F.col(f"flow_{s}") * (w / total) for s, w, _ in scores), F.lit(0.0))
    wide = wide.withColumn("net_flow", F.round(net, 9))
    order = wide.select(key, *(F.round(f"flow_{s}", 9).alias(f"flow_{s}") for s in names), "net_flow", (-F.col("net_flow")).alias("_o"),
        F.lit(1).cast("long").alias("_one"))
    return prefix_sums(order, [], ["_o", key], ["_one"]).select(key, *(f"flow_{s}" for s in names), "net_flow", F.col("cum__one").alias("rank"))


def family_scores(families: DataFrame) -> DataFrame:
    """One row per family: removable, score, commonness, and sem as the sum over
    its locations (null if no location has one)."""
    sem = F.expr("filter(transform(locations, l -> l.sem), s -> s IS NOT NULL)")
    sem = F.when(F.size(sem) > 0, F.aggregate(sem, F.lit(0).cast("long"), lambda a, x: a + x))
    one = families.filter("family_id IS NOT NULL").select("family_id", "removable", "score", "commonness", sem.alias("sem"))
    return one.groupBy("family_id").agg(*(F.max(c).alias(c) for c in ("removable", "score", "commonness", "sem")))


def p3_ranking(spark, sf_dir: str) -> DataFrame:
    from ..tables import table

    return net_flow(family_scores(table(spark, sf_dir, "families")), "family_id", FAMILY_SCORES)


def agreement(ranking: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """(name, auc): for each column of `by`, the chance that a family graded 2 or
    more stands before one graded less (ties half). A family's grade is the mean
    of its reviewers'."""
    grade = labels.filter("grade IS NOT NULL").groupBy("family_id").agg((F.avg("grade") >= 1.5).alias("good"))
    j = ranking.join(grade, "family_id")
    out = None
    for name in by:
        v = j.groupBy(F.col(name).alias("x")).agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
        c = prefix_sums(v, [], ["x"], ["b"])
        one = c.agg(F.sum(F.col("g") * (F.col("cum_b") - F.col("b") / 2)).alias("u"), F.sum("g").alias("g"), F.sum("b").alias("b"))
        one = one.select(F.lit(name).alias("name"), F.round(F.col("u") / (F.col("g") * F.col("b")), 6).alias("auc"))
        out = one if out is None else out.unionByName(one)
    return out


def p3_agreement(spark, sf_dir: str) -> DataFrame:
    from ..tables import table

    ranking = cut(p3_ranking(spark, sf_dir))
    return agreement(ranking, table(spark, sf_dir, "review_labels"), ["net_flow", *(f"flow_{s}" for s, _, _ in FAMILY_SCORES)])


_ITEMS_SQL = """
items AS (
  SELECT family_id, max(removable)::DOUBLE AS removable, max(score) AS score, -max(commonness) AS commonness,
         max(list_sum(list_filter(list_transform(locations, lambda l: l.sem), lambda s: s IS NOT NULL)))::DOUBLE AS sem
  FROM families WHERE family_id IS NOT NULL GROUP BY family_id),
long AS (
  SELECT family_id, 'removable' AS s, removable AS x FROM items UNION ALL SELECT family_id, 'score', score FROM items
  UNION ALL SELECT family_id, 'commonness', commonness FROM items UNION ALL SELECT family_id, 'sem', sem FROM items),
ranked AS (
  SELECT family_id, s, 2 * (rank() OVER w - 1) + count(*) OVER (PARTITION BY s, x) AS m, count(*) OVER (PARTITION BY s) AS n
  FROM long WHERE x IS NOT NULL AND NOT isnan(x) WINDOW w AS (PARTITION BY s ORDER BY x)),
steps AS (SELECT s, any_value(n) AS n, round(any_value(n) * 0.1)::BIGINT AS q, greatest(round(any_value(n) * 1.0)::BIGINT, round(any_value(n) *
  0.1)::BIGINT + 1) AS p FROM ranked GROUP BY s),
pairs AS (
  SELECT a.family_id, a.s, t.n,
         sum(greatest(0, least(1, (a.m - b.m - t.q)::DOUBLE / (t.p - t.q))) - greatest(0, least(1, (b.m - a.m - t.q)::DOUBLE / (t.p - t.q)))) AS d
  FROM ranked a JOIN ranked b ON a.s = b.s JOIN steps t ON t.s = a.s GROUP BY a.family_id, a.s, t.n),
flows AS (SELECT family_id, s, CASE WHEN n > 1 THEN d / (n - 1) ELSE 0 END AS flow FROM pairs),
wide AS (
  SELECT i.family_id, coalesce(max(flow) FILTER (s = 'removable'), 0) AS f1, coalesce(max(flow) FILTER (s = 'score'), 0) AS f2,
         coalesce(max(flow) FILTER (s = 'commonness'), 0) AS f3, coalesce(max(flow) FILTER (s = 'sem'), 0) AS f4
  FROM items i LEFT JOIN flows f ON f.family_id = i.family_id GROUP BY i.family_id)
"""

#: The definition itself: every family against every other, score by score.
P3_SQL = f"""
WITH {_ITEMS_SQL},
net AS (SELECT *, round(f1 * 0.25 + f2 * 0.25 + f3 * 0.25 + f4 * 0.25, 9) AS net_flow FROM wide)
SELECT family_id, round(f1, 9) AS flow_removable, round(f2, 9) AS flow_score, round(f3, 9) AS flow_commonness, round(f4, 9) AS flow_sem,
       net_flow, row_number() OVER (ORDER BY net_flow DESC, family_id) AS rank
FROM net
"""
