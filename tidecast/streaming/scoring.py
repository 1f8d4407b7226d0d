"""Forecasts of a stream: each series keeps the few last values its networks need, and forecasts anew with each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidecast.functions import arrays as A
from tidecast.operators import forecasting as fc
from tidecast.operators.design import path
from tidecast.operators.regression import combined

STATE = "t int, tail array<double>, regressors array<array<double>>"
TAIL = "series_id string, t int, need int, tail array<double>, regressors array<array<double>>"


def score(stream: DataFrame, plans: DataFrame, models: DataFrame, spec: fc.Spec, h: int = 1) -> DataFrame:
    """stream(series_id, t, y[, x]) -> (series_id, t: last step seen, h, yhat), in append mode.

    Steps at or before the last one seen are late and left out; after a gap a series starts over. Nothing comes out until a
    series has the steps that its lags and differences need. Members are combined as spec says. Regressors x count up to the
    last step seen: a plan that needs later ones gives null from there on. A series without plan gives nothing.

    An event carries only the number of steps to keep through the shuffle; networks meet the kept steps afterwards, once a
    series and micro-batch.
    """
    good = plans.where("status = 'ok'")
    lagged = F.concat("lags", F.flatten("xreg_lags"), F.array(F.lit(0)))
    need = good.select("series_id", (F.aggregate("difforder", F.lit(0), lambda n, k: n + k) + F.array_max(lagged) + 1).alias("need"))
    x = F.col("x") if "x" in stream.columns else F.lit(None).cast("array<double>")
    events = stream.select(F.col("series_id").cast("string").alias("series_id"), "t", F.col("y").cast("double").alias("y"), x.alias("x")).where("y is not null").join(need, "series_id")

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        need = int(pdf["need"].iloc[0])
        last, tail, own = state.get if state.exists else (None, [], [])
        tail, own = list(tail), [list(v) for v in own]
        for t, y, x in pdf[["t", "y", "x"]].drop_duplicates("t").sort_values("t").itertuples(index=False):
            if last is None or t > last:
                goes_on, x = last is None or t == last + 1, [] if x is None else [float(v) for v in x]
                tail, own = ([*tail, float(y)] if goes_on else [float(y)])[-need:], ([*own, x] if goes_on else [x])[-need:]
                last = int(t)
        state.update((last, tail, own))
        if len(tail) == need:
            yield pd.DataFrame([(key[0], last, need, tail, own)], columns=["series_id", "t", "need", "tail", "regressors"])

    tails = events.groupBy("series_id").applyInPandasWithState(keep, TAIL, STATE, "append", GroupStateTimeout.NoTimeout)
    members = models.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("rep", "activation", "layers", "direct"))).alias("members"))
    ready = tails.withColumnRenamed("t", "last").join(good.join(members, "series_id"), "series_id")
    units = ready.withColumns({"y": F.col("tail"), "x": F.when(F.size("xreg_lags") > 0, F.col("regressors"))})
    paths = units.select("series_id", F.col("last").alias("t"), path(F.col("members"), F.lit(h), F.lit(spec.phase) + F.col("last") - F.col("need")).alias("m"))
    at = F.transform(A.upto(0, h - 1), lambda i: F.transform("m", lambda m: F.get(m["yhat"], i)))
    each = paths.select("series_id", "t", F.posexplode(at).alias("h", "v")).withColumn("h", F.col("h") + 1)
    return each.select("series_id", "t", "h", F.when(~F.exists("v", lambda v: v.isNull()), combined(F.col("v"), spec.comb)).alias("yhat"))
