"""Series beside their plans as rows of arrays, and what plans make of them: the design table, forecasts and one-step values.

All of it is expressions: a row is a series with its values in order, so lags are places in an array, differences a fold over the
plan's orders, and a recursive forecast a fold over the horizon that carries the last values its lags need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions import arrays as A

PLAN = "series_id string, status string, warning string, season double, difforder array<int>, lags array<int>, xreg_lags array<array<int>>, periods array<double>, det_type string, low double, high double, x_low array<double>, x_high array<double>, inputs int, rows int, hidden array<int>, hidden_errors array<struct<hidden:int,mse:double>>"
PLAN_NAMES = [c.split(" ")[0] for c in PLAN.split(", ")]


def spread(units: DataFrame, *keys: str) -> DataFrame:
    """units dealt out by keys over as many tasks as the cluster runs at once, since few rows would share one."""
    spark = units.sparkSession
    return units.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def packed(series: DataFrame) -> DataFrame:
    """A row for each series: (series_id, t, y up to its last value, x of all steps or null, width of x, sound).

    Only the columns that are used go through the shuffle. sound is false where a value is missing or not finite, or a step
    occurs twice. width is -1 where steps have unlike numbers of regressors.
    """
    x = F.col("x") if "x" in series.columns else F.lit(None).cast("array<double>")
    step = F.struct(F.col("t").cast("int").alias("t"), F.nanvl(F.col("y").cast("double"), F.lit(None)).alias("y"), x.cast("array<double>").alias("x"))
    rows = series.select(F.col("series_id").cast("string").alias("series_id"), step.alias("s")).groupBy("series_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    seen = F.coalesce(F.array_max(F.transform("s", lambda v, i: F.when(v["y"].isNotNull(), i + 1))), F.lit(0))
    cut = rows.withColumn("n", seen).select("series_id", F.col("s.t").alias("t"), F.slice("s.y", F.lit(1), F.col("n")).alias("y"), F.when(F.forall("s.x", lambda v: v.isNotNull()) & (F.size("s") > 0), F.col("s.x")).alias("x"))
    widths = F.array_distinct(F.transform("x", lambda v: F.size(v)))
    whole = F.forall("y", A.finite) & (F.size(F.array_distinct("t")) == F.size("t")) & F.coalesce(F.forall("x", lambda v: F.forall(v, A.finite)), F.lit(True))
    return cut.select("*", F.when(F.col("x").isNull(), 0).when(F.size(widths) == 1, F.get(widths, F.lit(0))).otherwise(-1).alias("width"), whole.alias("sound"))


def planned(series: DataFrame, plans: DataFrame, how: str = "inner") -> DataFrame:
    """Packed series beside their plans."""
    return packed(series).join(plans.select(*PLAN_NAMES), "series_id", how)


def shift() -> Column:
    return F.aggregate("difforder", F.lit(0), lambda s, k: s + k)


def depth(lags: Column | None = None, xreg_lags: Column | None = None) -> Column:
    """Steps before the first that has all its lags."""
    lags, xreg_lags = F.col("lags") if lags is None else lags, F.col("xreg_lags") if xreg_lags is None else xreg_lags
    return F.greatest(F.coalesce(F.array_max(lags), F.lit(0)), F.coalesce(F.array_max(F.flatten(xreg_lags)), F.lit(0)))


def prepared(phase: Column, build: Callable[[Column, Column, Column], Column]) -> Column:
    """build(z, x, start): the scaled last differences, the scaled regressors on their steps, and the place of z's first step in the season."""
    z = A.let(A.ladder(F.col("y"), F.col("difforder")), lambda d: F.transform(d, lambda v: A.scaled(v, F.col("low"), F.col("high"))))
    one = lambda row: F.transform(row, lambda v, j: A.scaled(v, F.get("x_low", j), F.get("x_high", j)))
    x = F.when(F.size("x_low") > 0, F.transform(F.slice("x", shift() + 1, F.greatest(F.size("x") - shift(), F.lit(0))), one))
    return A.let(z, lambda z: A.let(x, lambda x: A.let(shift() + phase, lambda start: build(z, x, start))))


def inputs(lagged: Callable[[Column], Column], x: Column, i: Column, start: Column) -> Column:
    """The inputs of step i: lags (lagged(k) is the value k steps before), lags of each regressor, dummies of each period."""
    own = F.transform("lags", lagged)
    outside = F.flatten(F.transform("xreg_lags", lambda ks, j: F.transform(ks, lambda k: F.get(F.get(x, i - k), j))))
    dummies = F.flatten(F.transform("periods", lambda m: A.season_columns(i + start, m, F.col("det_type"))))
    return F.concat(own, outside, dummies)


def design(units: DataFrame, phase: int, *keep: str) -> DataFrame:
    """(keep..., at: step of the differences from 0, target, x: inputs), the rows of a unit one after the other and in order."""

    def steps(z: Column, x: Column, start: Column) -> Column:
        row = lambda i: F.struct(i.alias("at"), F.get(z, i).alias("target"), inputs(lambda k: F.get(z, i - k), x, i, start).alias("x"))
        return A.let(depth(), lambda first: F.transform(A.upto(first, F.size(z) - 1), row))

    return units.select(*keep, F.explode(prepared(F.lit(phase), steps)).alias("_r")).select(*keep, "_r.at", "_r.target", "_r.x")


def levels() -> Column:
    """For each order of differences (k, level): the values that it was taken of."""
    return F.transform("difforder", lambda k, i: F.struct(k.alias("k"), A.ladder(F.col("y"), F.slice("difforder", F.lit(1), i)).alias("level")))


def undone(ahead: Column) -> Column:
    """Differences ahead of the last step put back on what they were taken of, order by order from the last."""
    grown = lambda a, s: A.let(F.aggregate(a, F.slice(s["level"], -s["k"], s["k"]), lambda w, v: F.concat(w, F.array(v + F.element_at(w, -s["k"])))), lambda w: F.slice(w, s["k"] + 1, F.size(w) - s["k"]))
    return F.aggregate(F.reverse(levels()), ahead, grown)


def path(members: Column, h: Column, phase: Column) -> Column:
    """array<struct<rep, yhat array<double>>>: the forecast of each member for h steps, each step on the ones before.

    A missing regressor makes it null from there on. A constant series is carried on; any other without networks gets nulls.
    """
    empty = F.transform(A.upto(1, h), lambda _: F.lit(None).cast("double"))

    def recursive(z: Column, x: Column, start: Column) -> Column:
        n, need = F.size(z), F.greatest(F.coalesce(F.array_max("lags"), F.lit(0)), F.lit(1))
        tail = F.slice(z, F.greatest(n - need + 1, F.lit(1)), need)

        def one(m: Column, tail: Column) -> Column:
            def step(s: Column, j: Column) -> Column:
                v = A.network(inputs(lambda k: F.element_at(s["ring"], -k), x, n - 1 + j, start), m)
                return A.let(v, lambda v: F.struct(F.concat(F.slice(s["ring"], F.lit(2), F.size(s["ring"]) - 1), F.array(v)).alias("ring"), F.concat(s["out"], F.array(v)).alias("out")))

            begin = F.struct(tail.alias("ring"), A.none().alias("out"))
            ahead = F.aggregate(A.upto(1, h), begin, step, lambda s: F.transform(s["out"], lambda v: A.unscaled(v, F.col("low"), F.col("high"))))
            return F.struct(m["rep"].alias("rep"), undone(ahead).alias("yhat"))

        return A.let(tail, lambda tail: F.transform(members, lambda m: one(m, tail)))

    alone = lambda v: F.array(F.struct(F.lit(0).alias("rep"), v.alias("yhat")))
    found = F.when((F.col("status") == "ok") & (F.size(members) > 0), prepared(phase, recursive)).when(F.col("status") == "constant", alone(undone(F.transform(A.upto(1, h), lambda _: F.col("low"))))).otherwise(alone(empty))
    return F.transform(found, lambda m: F.struct(m["rep"].alias("rep"), F.transform(m["yhat"], lambda v: F.when(A.finite(v), v)).alias("yhat")))


def one_step(units: DataFrame, phase: int) -> DataFrame:
    """(series_id, rep, t, y, fitted) from units with members: predictions of the differences, put back on the actual lagged levels."""

    def steps(z: Column, x: Column, start: Column) -> Column:
        # level l begins sum(difforder[:l]) steps after y; what step `pos` of y adds to is k steps before
        behind = F.transform(levels(), lambda s: F.struct(s["k"].alias("k"), s["level"].alias("level"), (F.size("y") - F.size(s["level"])).alias("late")))
        known = lambda held, pos: F.aggregate(held, F.lit(0.0), lambda a, s: a + F.get(s["level"], pos - s["k"] - s["late"]))

        def row(i: Column, held: Column) -> Column:
            pos = i + shift()
            values = A.let(inputs(lambda k: F.get(z, i - k), x, i, start), lambda v: A.let(known(held, pos), lambda b: F.transform("members", lambda m: F.struct(m["rep"].alias("rep"), (A.unscaled(A.network(v, m), F.col("low"), F.col("high")) + b).alias("fitted")))))
            return F.struct(F.get("t", pos).alias("t"), F.get("y", pos).alias("y"), values.alias("each"))

        return A.let(behind, lambda held: A.let(depth(), lambda first: F.transform(A.upto(first, F.size(z) - 1), lambda i: row(i, held))))

    rows = units.select("series_id", F.explode(prepared(F.lit(phase), steps)).alias("_r"))
    return rows.select("series_id", "_r.t", "_r.y", F.explode("_r.each").alias("_m")).select("series_id", "_m.rep", "t", "y", "_m.fitted")
