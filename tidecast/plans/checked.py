"""Queries that run the forecasting engine itself on plans whose results SQL can express, each with that SQL.

An extreme learning machine without a hidden layer is a regression on its inputs; with one lag, its weights are a slope and an
intercept. The rest is what every other plan goes through: differences, scaling, inputs, one-step and recursive forecasts, what
undoes the differences, combination, padding, errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import forecasting as fc
from tidecast.operators import regression
from tidecast.plans.native import NEURON, SCALED, SERIES, WIN, neuron_sql, orders_monthly
from tidecast.sources.series import series_from
from tidecast.sources.written import materialise

LINEAR = fc.Spec(type="ls", hidden=0, direct=True, reps=1, lags=(1,), difforder=(1, 12), select=False, dummies=False)
#: The 5 per cent point of the chi-square distribution with 11 degrees of freedom. Fixed value.
SEASONAL = 19.67513757268249


def linear(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    series = materialise(orders_monthly(spark, sf_dir), "series")
    plans = materialise(fc.specify(series, LINEAR), "plans")
    return series, plans, materialise(fc.fit(series, plans, LINEAR), "models")


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, plans, models = linear(spark, sf_dir)
    return fc.residuals(series, fc.fitted(series, plans, models, LINEAR), LINEAR)


LADDER = f""", d1 AS (SELECT *, y - lag(y) OVER {WIN} AS d1 FROM s), d2 AS (SELECT *, d1 - lag(d1, 12) OVER {WIN} AS d2 FROM d1),
e AS (SELECT *, min(d2) OVER (PARTITION BY series_id) AS low, max(d2) OVER (PARTITION BY series_id) AS high FROM d2),
z AS (SELECT *, 1.6 * (d2 - low) / (high - low) - 0.8 AS z FROM e WHERE d2 IS NOT NULL), l AS (SELECT *, lag(z) OVER {WIN} AS x FROM z),
a AS (SELECT series_id, regr_slope(z, x) AS slope, regr_intercept(z, x) AS icept, max_by(z, t) AS last, max(t) AS n, max(low) AS low, max(high) AS high FROM l GROUP BY series_id),
f AS (SELECT l.series_id, l.t, (a.icept + a.slope * l.x + 0.8) / 1.6 * (a.high - a.low) + a.low AS d2hat FROM l JOIN a USING (series_id) WHERE l.x IS NOT NULL),
b AS (SELECT series_id, t, y, lag(y) OVER {WIN} AS y1, lag(d1, 12) OVER {WIN} AS d12 FROM d1),
r AS (SELECT b.series_id, b.t, b.y, f.d2hat + b.d12 + b.y1 AS fitted FROM b LEFT JOIN f USING (series_id, t))"""


def member_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, plans, models = linear(spark, sf_dir)
    return fc.ensemble(fc.predict(series, plans, models, LINEAR, 12), ["series_id", "h"]).select("series_id", "h", F.round("yhat", 3).alias("yhat"))


FORECAST_SQL = f"""WITH RECURSIVE {SERIES} {LADDER},
p(series_id, h, v) AS (SELECT series_id, 0, last FROM a UNION ALL SELECT p.series_id, p.h + 1, a.icept + a.slope * p.v FROM p JOIN a ON a.series_id = p.series_id WHERE p.h < 12),
g AS (SELECT p.series_id, p.h, (p.v + 0.8) / 1.6 * (a.high - a.low) + a.low + d1.d1 AS step FROM p JOIN a ON a.series_id = p.series_id JOIN d1 ON d1.series_id = p.series_id AND d1.t = a.n + p.h - 12 WHERE p.h > 0)
SELECT g.series_id, g.h, round(s.y + sum(g.step) OVER (PARTITION BY g.series_id ORDER BY g.h), 3) AS yhat FROM g JOIN a ON a.series_id = g.series_id JOIN s ON s.series_id = g.series_id AND s.t = a.n"""


def season_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.season_tests(orders_monthly(spark, sf_dir), 12).select("series_id", "seasons", F.round("stat", 6).alias("stat"), F.round("p_value", 9).alias("p_value"), "seasonal")


SEASON_SQL = f"""WITH {SERIES}, n AS (SELECT *, max(t) OVER (PARTITION BY series_id) AS n, min(y) OVER (PARTITION BY series_id) AS least FROM s),
c AS (SELECT *, CASE WHEN t > 6 AND t <= n - 6 THEN (sum(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + 0.5 * lag(y, 6) OVER {WIN} + 0.5 * lead(y, 6) OVER {WIN}) / 12 END AS inner_cma FROM n),
h AS (SELECT *, first_value(inner_cma IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head, last_value(inner_cma IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM c),
v AS (SELECT series_id, (t - 1) // 12 AS block, (t - 1) % 12 AS season, n // 12 AS seasons, coalesce(inner_cma, CASE WHEN t <= 6 THEN head ELSE tail END) AS cma, y, least FROM h WHERE t <= n // 12 * 12),
k AS (SELECT series_id, block, season, seasons, CASE WHEN least > 0 THEN y / cma ELSE y - cma END AS v FROM v),
q AS (SELECT *, rank() OVER (PARTITION BY series_id, block ORDER BY v) + (count(*) OVER (PARTITION BY series_id, block, v) - 1) / 2.0 AS r FROM k),
m AS (SELECT series_id, seasons, season, CAST(sum(r) AS DOUBLE) AS total, CAST(sum((r - 6.5) * (r - 6.5)) AS DOUBLE) AS spread FROM q GROUP BY 1, 2, 3),
w AS (SELECT series_id, CAST(seasons AS INT) AS seasons, 11 * sum((total - seasons * 6.5) * (total - seasons * 6.5)) / sum(spread) AS stat FROM m GROUP BY 1, 2)
SELECT series_id, seasons, round(stat, 6) AS stat, round(1 - (SELECT sum(exp(-stat / 2 + (5.5 + k) * ln(stat / 2) - lgamma(6.5 + k))) FROM (SELECT unnest(range(0, 400)) AS k)), 9) AS p_value, stat >= {SEASONAL} AS seasonal FROM w"""


def fixed_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's forward pass with the weights of one given neuron, on the last value and that of a year ago."""
    spec = fc.Spec(barebone=True, hidden=1, reps=1, lags=(1, 12), difforder=(0,), select=False, dummies=False)
    series = materialise(orders_monthly(spark, sf_dir), "series")
    plans = fc.specify(series, spec)
    b0, w1, w2, c0, c1 = NEURON
    weights = F.array(F.array(*(F.array(F.lit(w)) for w in (b0, w1, w2))), F.array(*(F.array(F.lit(w)) for w in (c0, c1))))
    models = series.select("series_id").distinct().select("series_id", F.lit(0).alias("rep"), F.lit("softsign").alias("activation"), weights.alias("layers"), F.array().cast("array<double>").alias("direct"))
    return fc.fitted(series, plans, models, spec).select("series_id", "t", F.round("fitted", 3).alias("fitted"))


FIXED_SQL = f"""WITH {SERIES} {SCALED}, l AS (SELECT series_id, t, low, high, lag(y_sc, 1) OVER {WIN} AS a, lag(y_sc, 12) OVER {WIN} AS b FROM z)
SELECT series_id, t, round(({neuron_sql("a", "b")} + 0.8) / 1.6 * (high - low) + low, 3) AS fitted FROM l WHERE t > 12"""


def linear_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of a line from its quantity by return flag, through the table regression without neurons."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_extendedprice", "l_quantity")
    models = regression.fit(table, "l_returnflag", "l_extendedprice", ["l_quantity"], hidden=0, kind="ls", reps=1, direct=True)
    scored = regression.predict(table, models, "l_returnflag", ["l_quantity"])
    return scored.groupBy("l_returnflag").agg(F.count("yhat").alias("n"), F.round(F.avg(F.pow(F.col("l_extendedprice") - F.col("yhat"), 2)) / 1e6, 4).alias("mse_millions"), F.round(F.max("yhat"), 2).alias("most"))


LINEAR_TABLE_SQL = """WITH a AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS icept FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, count(*) AS n, round(avg(pow(l_extendedprice - (icept + slope * l_quantity), 2)) / 1e6, 4) AS mse_millions, round(max(icept + slope * l_quantity), 2) AS most FROM lineitem JOIN a USING (l_returnflag) GROUP BY l_returnflag"""


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As linear_table on two inputs that come as one array: least squares through the sums of products."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_extendedprice", F.array("l_quantity", "l_tax").cast("array<double>").alias("x"))
    models = regression.fit(table, "l_returnflag", "l_extendedprice", "x", hidden=0, kind="ls", reps=1, direct=True)
    scored = regression.predict(table, models, "l_returnflag", "x")
    return scored.groupBy("l_returnflag").agg(F.count("yhat").alias("n"), F.round(F.avg(F.pow(F.col("l_extendedprice") - F.col("yhat"), 2)) / 1e6, 4).alias("mse_millions"), F.round(F.max("yhat"), 2).alias("most"))


#: Two slopes by Cramer's rule from variances and covariances.
VECTOR_TABLE_SQL = """WITH v AS (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS a, CAST(l_tax AS DOUBLE) AS b FROM lineitem),
c AS (SELECT l_returnflag, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM v GROUP BY l_returnflag),
w AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb FROM c),
f AS (SELECT v.l_returnflag, v.y, w.my + w.wa * (v.a - w.ma) + w.wb * (v.b - w.mb) AS yhat FROM v JOIN w USING (l_returnflag))
SELECT l_returnflag, count(*) AS n, round(avg(pow(y - yhat, 2)) / 1e6, 4) AS mse_millions, round(max(yhat), 2) AS most FROM f GROUP BY l_returnflag"""


def combined(how: str):
    """The priorities of a month as members, combined as the engine combines networks."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        members = orders_monthly(spark, sf_dir).select("t", F.col("y").alias("yhat"))
        return fc.ensemble(members, ["t"], how=how).select("t", F.round("yhat", 3).alias("yhat"))

    return run


def forward_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("one", F.lit(1))
    return series_from(e, "event_type", "ts", "one", "hour", fill="forward", start="own").select("series_id", "t", "ts", F.col("y").cast("long").alias("n"))


FORWARD_SQL = """WITH raw AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2), hi AS (SELECT max(ts) AS hi FROM raw),
cal AS (SELECT series_id, unnest(generate_series(min(ts), (SELECT hi FROM hi), INTERVAL 1 HOUR)) AS ts FROM raw GROUP BY series_id)
SELECT c.series_id, CAST(row_number() OVER (PARTITION BY c.series_id ORDER BY c.ts) AS INT) AS t, c.ts, last_value(raw.n IGNORE NULLS) OVER (PARTITION BY c.series_id ORDER BY c.ts) AS n FROM cal c LEFT JOIN raw ON raw.series_id = c.series_id AND raw.ts = c.ts"""

def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("one", F.lit(1))
    return series_from(o, "o_orderpriority", "o_orderdate", "one", "week", start="own").select("series_id", "t", "ts", F.col("y").cast("long").alias("n"))


WEEKLY_SQL = """WITH raw AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS ts, count(*) AS n FROM orders GROUP BY 1, 2), hi AS (SELECT max(ts) AS hi FROM raw),
cal AS (SELECT series_id, unnest(generate_series(min(ts), (SELECT hi FROM hi), INTERVAL 7 DAY)) AS ts FROM raw GROUP BY series_id)
SELECT c.series_id, CAST(row_number() OVER (PARTITION BY c.series_id ORDER BY c.ts) AS INT) AS t, c.ts, coalesce(raw.n, 0) AS n FROM cal c LEFT JOIN raw ON raw.series_id = c.series_id AND raw.ts = c.ts"""

CHECKED = {
    "engine_residuals": (lambda spark, d: residuals(spark, d).where("fitted is not null").select("series_id", "t", F.round("fitted", 3).alias("fitted"), F.round("residual", 3).alias("residual")), f"WITH {SERIES} {LADDER} SELECT series_id, t, round(fitted, 3) AS fitted, round(y - fitted, 3) AS residual FROM r WHERE fitted IS NOT NULL"),
    "engine_fitted_padded": (lambda spark, d: residuals(spark, d).select("series_id", "t", "y", F.round("fitted", 3).alias("fitted")), f"WITH {SERIES} {LADDER} SELECT series_id, t, y, round(fitted, 3) AS fitted FROM r"),
    "engine_fit_mse": (lambda spark, d: residuals(spark, d).groupBy("series_id").agg(F.round(F.avg(F.col("residual") * F.col("residual")) / 1e6, 4).alias("mse_millions"), F.count("residual").alias("n")), f"WITH {SERIES} {LADDER} SELECT series_id, round(avg(pow(y - fitted, 2)) / 1e6, 4) AS mse_millions, count(fitted) AS n FROM r GROUP BY series_id"),
    "engine_forecast": (member_forecast, FORECAST_SQL),
    "engine_season_test": (season_tests, SEASON_SQL),
    "engine_network_fitted": (fixed_network, FIXED_SQL),
    "engine_table_regression": (linear_table, LINEAR_TABLE_SQL),
    "engine_vector_regression": (vector_table, VECTOR_TABLE_SQL),
    "engine_combine_mean": (combined("mean"), f"WITH {SERIES} SELECT t, round(avg(y), 3) AS yhat FROM s GROUP BY t"),
    "engine_combine_median": (combined("median"), f"WITH {SERIES} SELECT t, round(median(y), 3) AS yhat FROM s GROUP BY t"),
    "weekly_series": (weekly, WEEKLY_SQL),
    "forward_filled_series": (forward_filled, FORWARD_SQL),
}
