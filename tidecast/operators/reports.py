"""Models as data: text summaries, networks as nodes and edges, and the lines of a forecast plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators.forecasting import Spec


def summary(plans: DataFrame, models: DataFrame, errors: DataFrame, spec: Spec) -> DataFrame:
    """A row for each series: sizes, differences as D1D12, lags, dummies, combination and mse (errors: series_id, mse)."""
    sizes = models.groupBy("series_id").agg(F.count(F.lit(1)).alias("reps"), F.array_join(F.transform(F.min_by("layers", "rep"), lambda w: F.size(w[0]).cast("string")), ",").alias("widths"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return plans.join(sizes, "series_id", "left").join(errors, "series_id", "left").select(
        "series_id", "status", F.lit(spec.kind).alias("kind"), F.coalesce("reps", F.lit(0)).alias("reps"), "widths",
        F.array_join(F.transform("difforder", lambda k: F.concat(F.lit("D"), k.cast("string"))), "").alias("differences"),
        text("lags").alias("lags"), F.size("xreg_lags").alias("regressors"),
        F.array_join(F.transform("xreg_lags", lambda ks: F.array_join(ks.cast("array<string>"), ",")), ";").alias("regressor_lags"),
        text("periods").alias("dummies"), "det_type", F.lit(spec.comb).alias("comb"), F.round("mse", 4).alias("mse"),
    )


def network_edges(models: DataFrame) -> DataFrame:
    """(series_id, rep, layer, from_idx, to_idx, weight, active); layers count from 1, index 0 is the bias.

    Layer 0 holds the weights that go straight from inputs to the output.
    """
    layer = models.select("series_id", "rep", F.posexplode("layers").alias("layer", "rows")).select("series_id", "rep", (F.col("layer") + 1).alias("layer"), F.posexplode("rows").alias("from_idx", "row"))
    edges = layer.select("series_id", "rep", "layer", "from_idx", F.posexplode("row").alias("to", "weight")).select("series_id", "rep", "layer", "from_idx", (F.col("to") + 1).alias("to_idx"), "weight")
    straight = models.select("series_id", "rep", F.lit(0).alias("layer"), F.posexplode("direct").alias("from", "weight")).select("series_id", "rep", "layer", (F.col("from") + 1).alias("from_idx"), F.lit(1).alias("to_idx"), "weight")
    return edges.unionByName(straight).withColumn("active", F.col("weight") != 0)


def network_nodes(plans: DataFrame, models: DataFrame) -> DataFrame:
    """(series_id, rep, layer, idx, kind): inputs are lag, regressor or dummy in the order of the input columns."""
    counts = [("lag", F.size("lags")), ("regressor", F.aggregate("xreg_lags", F.lit(0), lambda n, ks: n + F.size(ks)))]
    kinds = F.concat(*(F.array_repeat(F.lit(k), n) for k, n in counts), F.array_repeat(F.lit("dummy"), F.col("inputs") - counts[0][1] - counts[1][1]))
    inputs = models.join(plans, "series_id").select("series_id", "rep", F.lit(0).alias("layer"), F.posexplode(kinds).alias("idx", "kind"))
    last = F.col("layer") == F.col("n") - 1
    rest = models.select("series_id", "rep", F.size("layers").alias("n"), F.posexplode("layers").alias("layer", "rows")).select("series_id", "rep", (F.col("layer") + 1).alias("layer"), F.explode(F.sequence(F.lit(0), F.size(F.col("rows")[0]) - 1)).alias("idx"), F.when(last, "output").otherwise("hidden").alias("kind"))
    return inputs.unionByName(rest).withColumn("idx", F.col("idx") + 1)


def forecast_lines(series: DataFrame, members: DataFrame, one: DataFrame) -> DataFrame:
    """(series_id, kind, rep, t, value) of a forecast plot: history, members and their combination."""
    ends = series.where("y is not null").groupBy("series_id").agg(F.max("t").alias("n"))
    past = series.where("y is not null").select("series_id", F.lit("history").alias("kind"), F.lit(None).cast("int").alias("rep"), "t", F.col("y").alias("value"))
    each = members.join(ends, "series_id").select("series_id", F.lit("member").alias("kind"), "rep", (F.col("n") + F.col("h")).alias("t"), F.col("yhat").alias("value"))
    line = one.join(ends, "series_id").select("series_id", F.lit("ensemble").alias("kind"), F.lit(None).cast("int").alias("rep"), (F.col("n") + F.col("h")).alias("t"), F.col("yhat").alias("value"))
    return past.unionByName(each).unionByName(line)


def regression_summary(models: DataFrame, errors: DataFrame) -> DataFrame:
    """A row for each group of a table regression (errors: g, mse): members, neurons, inputs, how it was fitted and its error."""
    sizes = F.transform("members", lambda m: F.size(m["w_out"]) - 1)
    return models.join(errors, "g", "left").select(
        "g", F.size("members").alias("reps"), F.array_min(sizes).alias("least_neurons"), F.array_max(sizes).alias("most_neurons"),
        (F.size("low") - 1).alias("inputs"), F.exists("members", lambda m: F.size(m["direct"]) > 0).alias("direct"), "kind", "link", "settled", F.round("mse", 4).alias("mse"),
    )


def regression_scatter(scored: DataFrame, group: str, y: str) -> DataFrame:
    """(g, rep, fitted, actual) of a scatter plot, a point for each member and row; rep is null for their combination."""
    rows = scored.where("yhat is not null").select(F.col(group).cast("string").alias("g"), F.col(y).cast("double").alias("actual"), "yhat", "yhat_members")
    each = rows.select("g", F.posexplode("yhat_members").alias("rep", "fitted"), "actual")
    return each.unionByName(rows.select("g", F.lit(None).cast("int").alias("rep"), F.col("yhat").alias("fitted"), "actual"))


def fit_lines(series: DataFrame, each: DataFrame, one: DataFrame) -> DataFrame:
    """(series_id, kind, rep, t, value) of a plot of the fit: history, each member's one-step values (fitted's rows), and residuals' fitted ones."""
    past = series.where("y is not null").select("series_id", F.lit("history").alias("kind"), F.lit(None).cast("int").alias("rep"), "t", F.col("y").alias("value"))
    members = each.select("series_id", F.lit("member").alias("kind"), "rep", "t", F.col("fitted").alias("value"))
    line = one.where("fitted is not null").select("series_id", F.lit("ensemble").alias("kind"), F.lit(None).cast("int").alias("rep"), "t", F.col("fitted").alias("value"))
    return past.unionByName(members).unionByName(line)
