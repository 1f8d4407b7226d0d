"""Temporal hierarchies: series summed over every divisor of a season, and forecasts of all levels made to add up.

Reconciliation follows the structural scaling of Athanasopoulos et al. (2017): each level weighs by the steps it sums. The bottom
level b then solves (sum over levels of P_k) b = sum over levels of each level's forecasts spread evenly over their steps, where
P_k takes means over blocks of k steps. That sum of projections has eigenvalues between 1 and the number of levels, so
conjugate gradients settle in a few tens of rounds whatever the season's length; no matrix is formed, and a season is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions import arrays as A
from tidecast.functions.transforms import by_series
from tidecast.operators.design import spread

#: Rounds at most: 2 * sqrt(levels) * log(2 / 1e-15) / 2, enough for seasons of up to 100 divisors.
ROUNDS = 200


def divisors(m: int) -> list[int]:
    return [k for k in range(m, 0, -1) if m % k == 0]


def levels(series: DataFrame, m: int) -> DataFrame:
    """(series_id, k, t, y): sums of k steps for every k that divides m; the oldest steps short of whole seasons are left out."""
    cut = series.where("y is not null").withColumn("n", F.max("t").over(by_series())).withColumn("at", F.col("t") - 1 - F.pmod("n", F.lit(m))).where("at >= 0")
    each = cut.select("series_id", "at", "y", F.explode(F.array(*(F.lit(k) for k in divisors(m)))).alias("k"))
    return each.groupBy("series_id", "k", (F.floor(F.col("at") / F.col("k")) + 1).cast("int").alias("t")).agg(F.sum("y").alias("y"))


def block_means(v: Column, k: Column, m: int) -> Column:
    """Each step's mean over its block of k."""
    means = F.transform(A.upto(0, F.lit(m) / k - 1), lambda b: A.mean(F.slice(v, (b * k + 1).cast("int"), k)))
    return A.let(means, lambda a: F.transform(A.upto(0, m - 1), lambda i: F.get(a, F.floor(i / k).cast("int"))))


def summed(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def bottom(spread_out: Column, ks: Column, m: int) -> Column:
    """The b whose block means, summed over the levels ks, are spread_out: by conjugate gradients, as a fold."""
    zeros = F.transform(A.upto(1, m), lambda _: F.lit(0.0))
    through = lambda v: F.aggregate(ks, zeros, lambda s, k: summed(s, block_means(v, k, m)))
    along = lambda a, d, t: F.zip_with(a, d, lambda p, q: p + t * q)
    state = lambda b, r, d, rr, first: F.struct(b.alias("b"), r.alias("r"), d.alias("d"), rr.alias("rr"), first.alias("first"))

    def round_(s: Column, _: Column) -> Column:
        def moved(q: Column) -> Column:
            step = s["rr"] / A.dot(s["d"], q)
            return A.let(step, lambda t: A.let(along(s["r"], q, -t), lambda r: A.let(A.dot(r, r), lambda rr: state(along(s["b"], s["d"], t), r, along(r, s["d"], rr / s["rr"]), rr, s["first"]))))

        return F.when(s["rr"] > 1e-30 * s["first"], A.let(through(s["d"]), moved)).otherwise(s)

    begin = A.let(spread_out, lambda r: A.let(A.dot(r, r), lambda rr: state(zeros, r, r, rr, rr)))
    return A.let(begin, lambda s: F.aggregate(A.upto(1, ROUNDS), s, round_, lambda s: s["b"]))


def reconcile(base: DataFrame, m: int) -> DataFrame:
    """base(series_id, k, h, yhat) -> the same with sums that agree. A season that lacks a forecast gives nulls."""
    ks = F.array(*(F.lit(k) for k in divisors(m)))
    nodes = sum(m // k for k in divisors(m))
    per = F.lit(m) / F.col("k")
    node = F.struct(F.col("k").cast("int").alias("k"), F.pmod(F.col("h") - 1, per).cast("int").alias("j"), F.col("yhat").cast("double").alias("v"))
    seasons = base.select("series_id", F.floor((F.col("h") - 1) / per).cast("int").alias("season"), node.alias("n")).groupBy("series_id", "season").agg(F.sort_array(F.collect_list("n")).alias("n"), F.count("n.v").alias("seen"))
    level = lambda k: F.transform(F.filter("n", lambda x: x["k"] == k), lambda x: x["v"])
    zeros = F.transform(A.upto(1, m), lambda _: F.lit(0.0))
    even = F.aggregate(ks, zeros, lambda s, k: A.let(level(k), lambda a: summed(s, F.transform(A.upto(0, m - 1), lambda i: F.get(a, F.floor(i / k).cast("int")) / k))))
    found = F.when(F.col("seen") == nodes, bottom(even, ks, m))
    sums = lambda b: F.flatten(F.transform(ks, lambda k: F.transform(A.upto(0, F.lit(m) / k - 1), lambda j: F.struct(k.alias("k"), j.alias("j"), A.total(F.slice(b, (j * k + 1).cast("int"), k)).alias("v")))))
    rows = spread(seasons, "series_id", "season").select("series_id", "season", F.explode(A.let(found, sums)).alias("r"))
    return rows.select("series_id", F.col("r.k").alias("k"), (F.col("season") * (F.lit(m) / F.col("r.k")) + F.col("r.j") + 1).cast("int").alias("h"), F.col("r.v").alias("yhat"))
