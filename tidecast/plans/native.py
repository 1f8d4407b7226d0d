"""Queries in plain DataFrame functions, each with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions import transforms as T
from tidecast.operators import hierarchy
from tidecast.sources.series import series_from


def orders_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by priority and month; the last month is partial and left out."""
    return series_from(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", "month", trim=1, exact=True)


SERIES = """
raw AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders),
ends AS (SELECT min(ts) AS lo, max(ts) AS hi FROM raw),
cal AS (SELECT unnest(generate_series(lo, hi - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS ts FROM ends),
grid AS (SELECT i.series_id, c.ts, CAST(row_number() OVER (PARTITION BY i.series_id ORDER BY c.ts) AS INT) AS t FROM (SELECT DISTINCT series_id FROM raw) i CROSS JOIN cal c),
sums AS (SELECT series_id, ts, CAST(sum(v) AS DOUBLE) AS y FROM raw GROUP BY series_id, ts),
s AS (SELECT g.series_id, g.t, g.ts, coalesce(sums.y, 0.0) AS y FROM grid g LEFT JOIN sums ON sums.series_id = g.series_id AND sums.ts = g.ts)"""
WIN = "(PARTITION BY series_id ORDER BY t)"
SCALED = ", e AS (SELECT *, min(y) OVER (PARTITION BY series_id) AS low, max(y) OVER (PARTITION BY series_id) AS high FROM s), z AS (SELECT *, 1.6 * (y - low) / (high - low) - 0.8 AS y_sc FROM e WHERE high > low)"
AR = SCALED + f", l AS (SELECT *, lag(y_sc) OVER {WIN} AS x FROM z), a AS (SELECT series_id, regr_slope(y_sc, x) AS slope, regr_intercept(y_sc, x) AS icept, max_by(y_sc, t) AS last, max(t) AS n, max(low) AS low, max(high) AS high FROM l GROUP BY series_id)"


def ar1(series: DataFrame) -> DataFrame:
    """(series_id, slope, icept, last, n, low, high) of y_sc on its last value."""
    lagged = T.with_scaled(series).withColumn("x", F.lag("y_sc", 1).over(T.in_order()))
    return lagged.groupBy("series_id").agg(F.regr_slope("y_sc", "x").alias("slope"), F.regr_intercept("y_sc", "x").alias("icept"), F.max_by("y_sc", "t").alias("last"), F.max("t").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"))


def ar1_forecast(spark: SparkSession, sf_dir: str, h: int = 12) -> DataFrame:
    """Flagship: scale, fit, recurse h steps as a fold over an array, and scale back, without Python on the executors."""
    fit = ar1(orders_monthly(spark, sf_dir))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(h)), F.array("last"), lambda acc, _: F.concat(acc, F.array(F.col("icept") + F.col("slope") * F.element_at(acc, -1))))
    steps = fit.select("series_id", "low", "high", F.posexplode(path).alias("h", "v")).where("h > 0")
    return steps.select("series_id", "h", F.round(T.unscale(F.col("v"), F.col("low"), F.col("high")), 3).alias("yhat"))


def q(build, columns: str):
    """A query of the monthly series: build(series) and its columns as SQL expressions."""
    return lambda spark, sf_dir: build(orders_monthly(spark, sf_dir)).selectExpr(*columns.split("; "))


def friedman(series: DataFrame, m: int = 12) -> DataFrame:
    """Friedman statistic of the steps over their centred average, complete seasons only."""
    from pyspark.sql import Window

    d = T.centred_average(series, m).where("cma is not null").select("series_id", F.floor((F.col("t") - 1 - m // 2) / m).alias("block"), F.pmod(F.col("t") - 1 - m // 2, F.lit(m)).alias("season"), (F.col("y") / F.nullif(F.col("cma"), F.lit(0.0))).alias("v"))
    block = Window.partitionBy("series_id", "block")
    ranks = d.withColumns({"size": F.count(F.lit(1)).over(block), "r": F.rank().over(block.orderBy("v")), "ties": F.count(F.lit(1)).over(Window.partitionBy("series_id", "block", "v"))}).where(F.col("size") == m)
    sums = ranks.groupBy("series_id", "season").agg(F.sum(F.col("r") + (F.col("ties") - 1) / 2).alias("rank_sum"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy("series_id").agg(F.max("n").alias("blocks"), F.round(12 * F.sum(F.col("rank_sum") * F.col("rank_sum")) / (F.max("n") * m * (m + 1)) - 3 * F.max("n") * (m + 1), 6).alias("stat"))


def gap_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("one", F.lit(1))
    return series_from(e, "event_type", "ts", "one", "hour").select("series_id", "t", "ts", F.col("y").cast("long").alias("n"))


def aggregated(k: int):
    """Sums of k steps, the oldest incomplete group left out."""
    return lambda s: s.withColumn("n", F.max("t").over(T.by_series())).withColumn("g", F.floor((F.col("t") - 1 - F.pmod("n", F.lit(k))) / k)).where("g >= 0").groupBy("series_id", "g").agg(F.round(F.sum("y"), 3).alias("y"))


def aggregated_sql(k: int) -> str:
    return f"WITH {SERIES}, n AS (SELECT *, max(t) OVER (PARTITION BY series_id) AS n FROM s) SELECT series_id, CAST(floor((t - 1 - n % {k}) / {k}) AS BIGINT) AS g, round(sum(y), 3) AS y FROM n WHERE t > n % {k} GROUP BY 1, 2"


def reconciled(s: DataFrame, m: int = 4) -> DataFrame:
    """The median of each level as its forecast for a season, made to add up."""
    medians = hierarchy.levels(s, m).groupBy("series_id", "k").agg(F.median("y").alias("yhat"))
    base = medians.select("series_id", "k", F.explode(F.sequence(F.lit(1), (F.lit(m) / F.col("k")).cast("int"))).alias("h"), "yhat")
    return hierarchy.reconcile(base, m).select("series_id", "k", "h", F.round("yhat", 3).alias("yhat"))


def weights(m: int) -> list[tuple[int, int, int, int, float]]:
    """(out_k, out_j, k, j, weight): what each forecast of a season adds to each reconciled one; j from 0 within the season."""
    nodes = [(k, j) for k in hierarchy.divisors(m) for j in range(m // k)]
    s = np.array([[float(j * k <= i < (j + 1) * k) for i in range(m)] for k, j in nodes])
    scaled = s.T / np.array([k for k, _ in nodes])
    p = s @ np.linalg.solve(scaled @ s, scaled)
    return [(*out, *node, float(p[a, b])) for a, out in enumerate(nodes) for b, node in enumerate(nodes) if abs(p[a, b]) > 1e-12]


def reconciled_sql(m: int = 4) -> str:
    p = ", ".join(f"({a}, {b}, {k}, {j}, CAST({w!r} AS DOUBLE))" for a, b, k, j, w in weights(m))
    return f"""WITH {SERIES}, n AS (SELECT *, max(t) OVER (PARTITION BY series_id) AS n FROM s), c AS (SELECT series_id, t - 1 - n % {m} AS step, y FROM n WHERE t > n % {m}),
        l AS (SELECT series_id, k, step // k AS g, sum(y) AS y FROM c, (SELECT unnest({hierarchy.divisors(m)}) AS k) GROUP BY 1, 2, 3), b AS (SELECT series_id, k, median(y) AS v FROM l GROUP BY 1, 2),
        p(out_k, out_j, k, j, w) AS (VALUES {p}) SELECT series_id, CAST(out_k AS INT) AS k, CAST(out_j + 1 AS INT) AS h, round(sum(w * v), 3) AS yhat FROM b JOIN p USING (k) GROUP BY series_id, out_k, out_j"""


CMA_SQL = f"(sum(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + 0.5 * lag(y, 6) OVER {WIN} + 0.5 * lead(y, 6) OVER {WIN}) / 12"
LAGS = (1, 2, 3, 12)
#: Fixed weights of a small network with one hidden neuron.
NEURON = (0.1, 0.7, -0.2, 0.05, 1.3)


def neuron(x):
    b0, w1, w2, c0, c1 = NEURON
    return c0 + c1 * T.softsign(b0 + w1 * x[0] + w2 * x[1])


def neuron_sql(x: str, y: str) -> str:
    b0, w1, w2, c0, c1 = NEURON
    a = f"({b0} + {w1} * {x} + {w2} * {y})"
    return f"({c0} + {c1} * ({a} / (1 + abs{a})))"


def members(s: DataFrame) -> DataFrame:
    return s.select(F.col("series_id").alias("member"), "t", F.col("y").alias("yhat"))


def forward(s: DataFrame) -> DataFrame:
    z = T.with_lags(T.with_scaled(s), [1, 12], "y_sc")
    return z.select("series_id", "t", F.round(neuron([F.col("lag_1"), F.col("lag_12")]), 9).alias("out"))


NATIVE = {
    "monthly_series": (q(lambda s: s, "series_id; t; ts; y"), f"WITH {SERIES} SELECT series_id, t, ts, y FROM s"),
    "gap_filled_series": (gap_filled, """WITH raw AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts FROM events), ends AS (SELECT min(ts) AS lo, max(ts) AS hi FROM raw),
        cal AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM ends), grid AS (SELECT i.series_id, c.ts, CAST(row_number() OVER (PARTITION BY i.series_id ORDER BY c.ts) AS INT) AS t FROM (SELECT DISTINCT series_id FROM raw) i CROSS JOIN cal c)
        SELECT g.series_id, g.t, g.ts, count(raw.ts) AS n FROM grid g LEFT JOIN raw ON raw.series_id = g.series_id AND raw.ts = g.ts GROUP BY g.series_id, g.t, g.ts"""),
    "scale_minmax": (q(T.with_scaled, "series_id; t; round(y_sc, 9) as y_sc"), f"WITH {SERIES} {SCALED} SELECT series_id, t, round(y_sc, 9) AS y_sc FROM z"),
    "scale_roundtrip": (q(lambda s: T.with_scaled(s).withColumn("back", T.unscale(F.col("y_sc"), F.col("low"), F.col("high"))), "series_id; t; round(back, 3) as back; abs(back - y) < 1e-6 as same"), f"WITH {SERIES} {SCALED} SELECT series_id, t, round((high - low) * (y_sc + 0.8) / 1.6 + low, 3) AS back, true AS same FROM z"),
    "diff_1": (q(lambda s: T.difference(s, [1]), "series_id; t; round(d1, 6) as d1"), f"WITH {SERIES} SELECT series_id, t, round(y - lag(y) OVER {WIN}, 6) AS d1 FROM s"),
    "diff_1_12": (q(lambda s: T.difference(s, [1, 12]), "series_id; t; round(d2, 6) as d2"), f"WITH {SERIES}, d AS (SELECT *, y - lag(y) OVER {WIN} AS d1 FROM s) SELECT series_id, t, round(d1 - lag(d1, 12) OVER {WIN}, 6) AS d2 FROM d"),
    "lag_matrix": (q(lambda s: T.with_lags(s, list(LAGS)), "; ".join(["series_id", "t", "y", *[f"lag_{k}" for k in LAGS]])), f"WITH {SERIES}, l AS (SELECT series_id, t, y, {', '.join(f'lag(y, {k}) OVER {WIN} AS lag_{k}' for k in LAGS)} FROM s) SELECT * FROM l WHERE t > 12"),
    "cma_12": (q(lambda s: T.centred_average(s, 12).where("cma is not null"), "series_id; t; round(cma, 3) as cma"), f"WITH {SERIES}, c AS (SELECT series_id, t, {CMA_SQL} AS cma FROM s) SELECT series_id, t, round(cma, 3) AS cma FROM c WHERE cma IS NOT NULL"),
    "seas_dummies_bin": (q(lambda s: T.dummies(s, 12), "; ".join(["series_id", "t", *[f"d_{k}" for k in range(1, 12)]])), f"WITH {SERIES} SELECT series_id, t, {', '.join(f'CAST((t - 1) % 12 = {k} AS INT) AS d_{k}' for k in range(1, 12))} FROM s"),
    "seas_dummies_trig": (q(lambda s: T.dummies(s, 12, "trg"), "series_id; t; round(d_1, 9) + 0e0 as d_1; round(d_2, 9) + 0e0 as d_2"), f"WITH {SERIES} SELECT series_id, t, round(sin(2 * pi() * ((t - 1) % 12) / 12), 9) + 0e0 AS d_1, round(cos(2 * pi() * ((t - 1) % 12) / 12), 9) + 0e0 AS d_2 FROM s"),
    "friedman_stat": (lambda spark, d: friedman(orders_monthly(spark, d)), f"""WITH {SERIES}, c AS (SELECT series_id, t, y / ({CMA_SQL}) AS v FROM s), b AS (SELECT series_id, (t - 7) // 12 AS block, (t - 7) % 12 AS season, v FROM c WHERE v IS NOT NULL),
        r AS (SELECT *, count(*) OVER (PARTITION BY series_id, block) AS size, rank() OVER (PARTITION BY series_id, block ORDER BY v) AS r FROM b), g AS (SELECT series_id, season, CAST(sum(r) AS DOUBLE) AS rank_sum, count(*) AS n FROM r WHERE size = 12 GROUP BY 1, 2)
        SELECT series_id, max(n) AS blocks, round(12 * sum(rank_sum * rank_sum) / (max(n) * 12 * 13) - 3 * max(n) * 13, 6) AS stat FROM g GROUP BY series_id"""),
    "ar1_fit": (lambda spark, d: ar1(orders_monthly(spark, d)).select("series_id", F.round("slope", 9).alias("slope"), F.round("icept", 9).alias("icept")), f"WITH {SERIES} {AR} SELECT series_id, round(slope, 9) AS slope, round(icept, 9) AS icept FROM a"),
    "ar1_forecast": (ar1_forecast, f"WITH RECURSIVE {SERIES} {AR}, f(series_id, h, v) AS (SELECT series_id, 0, last FROM a UNION ALL SELECT f.series_id, f.h + 1, a.icept + a.slope * f.v FROM f JOIN a ON a.series_id = f.series_id WHERE f.h < 12) SELECT f.series_id, f.h, round((a.high - a.low) * (f.v + 0.8) / 1.6 + a.low, 3) AS yhat FROM f JOIN a ON a.series_id = f.series_id WHERE f.h > 0"),
    "combine_mean": (lambda spark, d: T.combine(members(orders_monthly(spark, d)), ["t"], "yhat", "mean").select("t", F.round("yhat", 3).alias("yhat")), f"WITH {SERIES} SELECT t, round(avg(y), 3) AS yhat FROM s GROUP BY t"),
    "combine_median": (lambda spark, d: T.combine(members(orders_monthly(spark, d)), ["t"], "yhat", "median").select("t", F.round("yhat", 6).alias("yhat")), f"WITH {SERIES} SELECT t, round(median(y), 6) AS yhat FROM s GROUP BY t"),
    "softsign_forward": (lambda spark, d: forward(orders_monthly(spark, d)), f"WITH {SERIES} {SCALED}, l AS (SELECT series_id, t, lag(y_sc, 1) OVER {WIN} AS a, lag(y_sc, 12) OVER {WIN} AS b FROM z) SELECT series_id, t, round({neuron_sql('a', 'b')}, 9) AS out FROM l WHERE t > 12"),
    "hierarchy_reconciled": (lambda spark, d: reconciled(orders_monthly(spark, d)), reconciled_sql()),
    "hierarchy_reconciled_12": (lambda spark, d: reconciled(orders_monthly(spark, d), 12), reconciled_sql(12)),
    **{f"temporal_aggregation_{k}": (lambda spark, d, k=k: aggregated(k)(orders_monthly(spark, d)), aggregated_sql(k)) for k in (3, 6, 12)},
}
