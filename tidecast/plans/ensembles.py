"""Queries that train networks; SQL can't express them, so tests hold them against known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.operators import forecasting as fc
from tidecast.operators import hierarchy, perceptron, regression, reports
from tidecast.plans.native import orders_monthly
from tidecast.sources.series import series_from
from tidecast.sources.written import materialise


def forecast(spec: fc.Spec, h: int | None = 12, source=orders_monthly, periods=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = materialise(source(spark, sf_dir), "series")
        plans = materialise(fc.specify(series, spec, periods(spark) if periods else None), "plans")
        members = fc.predict(series, plans, fc.fit(series, plans, spec), spec, h)
        return fc.ensemble(members, ["series_id", "h"], how=spec.comb)

    return run


def with_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value with the month's number of days and a trend as regressors, known a year ahead."""
    s = orders_monthly(spark, sf_dir)
    ends = s.groupBy("series_id").agg(F.max("t").alias("n"), F.max("ts").alias("ts"))
    ahead = ends.select("series_id", F.posexplode(F.expr("sequence(1, 12)")).alias("i", "k"), "n", "ts").select("series_id", (F.col("n") + F.col("k")).alias("t"), F.expr("ts + make_interval(0, k)").cast("timestamp_ntz").alias("ts"), F.lit(None).cast("double").alias("y"))
    return s.unionByName(ahead).withColumn("x", F.array(F.dayofmonth(F.last_day("ts")).cast("double"), F.col("t").cast("double")))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", F.lit(1).alias("one"))
    return series_from(e, "event_type", "ts", "one", "hour", trim=1)


def accuracy(spec: fc.Spec):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = materialise(orders_monthly(spark, sf_dir), "series")
        plans = materialise(fc.specify(series, spec), "plans")
        each = fc.fitted(series, plans, fc.fit(series, plans, spec), spec)
        return fc.residuals(series, each, spec).groupBy("series_id").agg(F.avg(F.col("residual") * F.col("residual")).alias("mse"), F.count("residual").alias("n"))

    return run


def report(build, spec: fc.Spec = fc.Spec(type="ridge", reps=2, hidden=8)):
    """A report of a monthly model: build(series, plans, models, spec)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = materialise(orders_monthly(spark, sf_dir), "series")
        plans = materialise(fc.specify(series, spec), "plans")
        return build(series, plans, materialise(fc.fit(series, plans, spec), "models"), spec)

    return run


def summary(series, plans, models, spec):
    errors = fc.residuals(series, fc.fitted(series, plans, models, spec), spec).groupBy("series_id").agg(F.avg(F.col("residual") * F.col("residual")).alias("mse"))
    return reports.summary(plans, models, errors, spec)


def lines(series, plans, models, spec):
    members = materialise(fc.predict(series, plans, models, spec), "members")
    return reports.forecast_lines(series, members, fc.ensemble(members, ["series_id", "h"]))


def fit_lines(series, plans, models, spec):
    each = materialise(fc.fitted(series, plans, models, spec), "fitted")
    return reports.fit_lines(series, each, fc.residuals(series, each, spec))


def before_last_year(series: DataFrame) -> DataFrame:
    """Each monthly series without its last twelve months."""
    return series.withColumn("last", F.max("t").over(Window.partitionBy("series_id"))).where(F.col("t") <= F.col("last") - 12).drop("last")


def reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of all months but the last year, applied to the whole series."""
    spec, series = fc.Spec(type="ridge", reps=5, hidden=10), materialise(orders_monthly(spark, sf_dir), "series")
    old = before_last_year(series)
    plans = materialise(fc.specify(old, spec), "plans")
    return fc.ensemble(fc.predict(series, fc.reuse(series, plans, spec), fc.fit(old, plans, spec), spec), ["series_id", "h"])


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of a line from its quantity, discount and tax, by return flag: mean squared error on all rows."""
    x = ["l_quantity", "l_discount", "l_tax"]
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_extendedprice", *x)
    models = regression.fit(table, "l_returnflag", "l_extendedprice", x, hidden=12, kind="ridge", reps=3, direct=True)
    scored = regression.predict(table, models, "l_returnflag", x)
    return scored.groupBy("l_returnflag").agg(F.count("yhat").alias("n"), F.round(F.avg(F.pow(F.col("yhat") - F.col("l_extendedprice"), 2)) / F.var_pop("l_extendedprice"), 4).alias("unexplained"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line costs over 30,000, from its quantity, discount and tax, by return flag: share right, and mean log-loss."""
    x = ["l_quantity", "l_discount", "l_tax"]
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", (F.col("l_extendedprice") > 30000).cast("double").alias("dear"), *x)
    models = regression.fit(table, "l_returnflag", "dear", x, hidden=10, kind="ridge", reps=3, direct=True, link="logistic")
    scored = regression.predict(table, models, "l_returnflag", x, "mean")
    sure = F.greatest(F.lit(1e-12), F.when(F.col("dear") == 1, F.col("yhat")).otherwise(1 - F.col("yhat")))
    return scored.groupBy("l_returnflag").agg(F.count("yhat").alias("n"), F.round(F.avg((sure > 0.5).cast("double")), 4).alias("share_right"), F.round(F.avg(-F.log(sure)), 4).alias("log_loss"))


def perceptrons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of a line from its quantity, discount and tax, by return flag, by perceptrons trained on all rows for 30 steps."""
    x = ["l_quantity", "l_discount", "l_tax"]
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_extendedprice", *x)
    models = perceptron.fit(table, "l_returnflag", "l_extendedprice", x, hidden=(3,), reps=2, steps=30)
    scored = perceptron.predict(table, models, "l_returnflag", x, "mean")
    errors = scored.groupBy("l_returnflag").agg(F.count("yhat").alias("n"), F.round(F.avg(F.pow(F.col("yhat") - F.col("l_extendedprice"), 2)) / F.var_pop("l_extendedprice"), 4).alias("unexplained"))
    return errors.join(models.select(F.col("g").alias("l_returnflag"), F.forall("members", lambda m: m["settled"]).alias("settled")), "l_returnflag")


def of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component of every embedding from the 63 others, by label: inputs that come as one array; share unexplained."""
    e = F.col("embedding").cast("array<double>")
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.get(e, F.lit(0)).alias("y"), F.slice(e, 2, 63).alias("x"))
    models = regression.fit(table, "label", "y", "x", hidden=20, kind="ridge", reps=3, direct=True)
    scored = regression.predict(table, models, "label", "x")
    return scored.groupBy("label").agg(F.count("yhat").alias("n"), F.round(F.avg(F.pow(F.col("yhat") - F.col("y"), 2)) / F.var_pop("y"), 4).alias("unexplained"))


def thief(kind: str):
    """Every level of the monthly hierarchy forecast for a year, then made to add up."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = None
        rows = materialise(hierarchy.levels(orders_monthly(spark, sf_dir), 12), "levels")
        for k in hierarchy.divisors(12):
            m = 12 // k
            spec = fc.Spec(kind=kind, type="ridge", hidden=6, reps=3, periods=(m,), lags=(1,) if m < 4 else None, difforder=(1,))
            one = fc.thief(rows.where(F.col("k") == k), spec, m)[0].withColumn("k", F.lit(k))
            base = one if base is None else base.unionByName(one)
        return hierarchy.reconcile(base, 12)

    return run


def own_periods(spark: SparkSession) -> DataFrame:
    """Seasons of half a year for one priority and of a quarter for another; the others keep their year."""
    return spark.createDataFrame([("1-URGENT", [6.0]), ("5-LOW", [3.0])], "series_id string, periods array<double>")


def line_price(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = ["l_quantity", "l_discount", "l_tax"]
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_extendedprice", *x)
    models = regression.fit(table, "l_returnflag", "l_extendedprice", x, hidden=12, kind="ridge", reps=2, direct=True)
    return models, regression.predict(table, models, "l_returnflag", x)


def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, scored = line_price(spark, sf_dir)
    errors = scored.groupBy(F.col("l_returnflag").alias("g")).agg(F.avg(F.pow(F.col("yhat") - F.col("l_extendedprice"), 2)).alias("mse"))
    return reports.regression_summary(models, errors)


def table_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.regression_scatter(line_price(spark, sf_dir)[1], "l_returnflag", "l_extendedprice")


ENSEMBLES = {
    "elm_ridge_forecast": forecast(fc.Spec(type="ridge", reps=5)),
    "elm_lasso_forecast": forecast(fc.Spec(type="lasso", reps=3)),
    "elm_step_forecast": forecast(fc.Spec(type="step", hidden=8, reps=3)),
    "elm_ls_direct_forecast": forecast(fc.Spec(type="ls", hidden=8, direct=True, reps=3, comb="mean", barebone=True)),
    "elm_seasonal_forecast": forecast(fc.Spec(type="ridge", difforder=(0,), reps=5)),
    "elm_barebone_ortho_forecast": forecast(fc.Spec(type="ridge", barebone=True, ortho=True, hidden=6, reps=5)),
    "elm_layers_forecast": forecast(fc.Spec(type="ridge", hidden=(10, 5), reps=5)),
    "elm_xreg_forecast": forecast(fc.Spec(type="ridge", reps=5, lags=(1, 2, 12), xreg_lags=((0,), (0, 1))), source=with_regressor),
    "elm_two_seasons_forecast": forecast(fc.Spec(type="ridge", reps=3, periods=(24, 168), lags=(1, 2, 24, 168), hidden=10), 24, hourly_events),
    "elm_reused_forecast": reused,
    "elm_thief_reconciled": thief("elm"),
    "mlp_thief_reconciled": thief("mlp"),
    "elm_default_forecast": forecast(fc.Spec()),
    "mlp_default_forecast": forecast(fc.Spec(kind="mlp")),
    "elm_least_error_forecast": forecast(fc.Spec(type="lasso", reps=3, penalty="min")),
    "elm_own_periods_forecast": forecast(fc.Spec(type="ridge", reps=3), None, periods=own_periods),
    "cross_section_elm": cross_section,
    "cross_section_elm_logistic": classified,
    "cross_section_perceptrons": perceptrons,
    "cross_section_vectors": of_vectors,
    "cross_section_summary": table_summary,
    "cross_section_scatter": table_scatter,
    "mlp_forecast": forecast(fc.Spec(kind="mlp", reps=5)),
    "mlp_layers_forecast": forecast(fc.Spec(kind="mlp", hidden=(4, 3), reps=3)),
    "mlp_cv_hidden": forecast(fc.Spec(kind="mlp", reps=2, lags=(1, 2, 12), hidden_type="cv", hidden_max=3)),
    "mlp_cv_in_time_hidden": forecast(fc.Spec(kind="mlp", reps=2, lags=(1, 2, 12), hidden_type="cv", hidden_max=3, folds="time")),
    "mlp_valid_hidden": forecast(fc.Spec(kind="mlp", reps=2, lags=(1, 2, 12), hidden_type="valid", hidden_max=4)),
    "mlp_elm_hidden": forecast(fc.Spec(kind="mlp", reps=3, hidden_type="elm")),
    "combine_mode": forecast(fc.Spec(type="ridge", reps=9, comb="mode")),
    "elm_fit_mse": accuracy(fc.Spec(type="ridge", reps=5)),
    "model_plans": report(lambda series, plans, models, spec: plans),
    "model_summary": report(summary),
    "network_edges": report(lambda series, plans, models, spec: reports.network_edges(models)),
    "network_nodes": report(lambda series, plans, models, spec: reports.network_nodes(plans, models)),
    "forecast_lines": report(lines),
    "fit_lines": report(fit_lines),
    "hidden_size_errors": report(lambda series, plans, models, spec: plans.select("series_id", "hidden", F.explode("hidden_errors").alias("e")).select("series_id", F.col("hidden")[0].alias("chosen"), "e.*"), fc.Spec(kind="mlp", reps=2, lags=(1, 2, 12), hidden_type="cv", hidden_max=3)),
}
