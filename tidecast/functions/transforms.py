"""Transforms of regular series as DataFrame expressions: scaling, differences, lags, moving averages, dummies, un-differencing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_series() -> WindowSpec:
    return Window.partitionBy("series_id")


def in_order() -> WindowSpec:
    return by_series().orderBy("t")


def scale(x: Column, low: Column, high: Column, mn: float = -0.8, mx: float = 0.8) -> Column:
    """x from [low, high] to [mn, mx]; null where the series is constant."""
    return F.when(high > low, (mx - mn) * (x - low) / F.nullif(high - low, F.lit(0.0)) + mn)


def unscale(x: Column, low: Column, high: Column, mn: float = -0.8, mx: float = 0.8) -> Column:
    return (high - low) * (x - mn) / (mx - mn) + low


def with_scaled(series: DataFrame, mn: float = -0.8, mx: float = 0.8) -> DataFrame:
    ends = series.withColumns({"low": F.min("y").over(by_series()), "high": F.max("y").over(by_series())})
    return ends.withColumn("y_sc", scale(F.col("y"), F.col("low"), F.col("high"), mn, mx))


def difference(series: DataFrame, order: list[int]) -> DataFrame:
    """Adds d1, d2, ...: differences at the lags of order, one after the other."""
    last = "y"
    for i, k in enumerate(order, 1):
        series = series.withColumn(f"d{i}", F.col(last) - F.lag(last, k).over(in_order()))
        last = f"d{i}"
    return series


def with_lags(series: DataFrame, lags: list[int], column: str = "y") -> DataFrame:
    """Adds lag_k for each k and keeps the steps that have them all."""
    return series.withColumns({f"lag_{k}": F.lag(column, k).over(in_order()) for k in lags}).where(F.col("t") > max(lags))


def centred_average(series: DataFrame, m: int) -> DataFrame:
    """Adds cma: the centred moving average of m steps (2 x m where m is even), null at the ends."""
    half = m // 2
    whole = in_order().rowsBetween(-half, half)
    total = F.sum("y").over(whole)
    if m % 2 == 0:
        total = F.sum("y").over(in_order().rowsBetween(-half + 1, half - 1)) + 0.5 * F.lag("y", half).over(in_order()) + 0.5 * F.lead("y", half).over(in_order())
    return series.withColumn("cma", F.when((F.count(F.lit(1)).over(whole) == 2 * half + 1), total / m))


def dummies(series: DataFrame, m: int, kind: str = "bin", phase: int = 0) -> DataFrame:
    """Adds d_1 .. d_(m-1) of 0 and 1, or the first sine and cosine; fit and forecast share the phase pmod(t - 1 + phase, m)."""
    at = F.pmod(F.col("t") - 1 + phase, F.lit(m))
    if kind == "bin":
        return series.withColumns({f"d_{k}": (at == k).cast("int") for k in range(1, m)})
    if kind != "trg":
        raise ValueError("kind is bin or trg")
    return series.withColumns({"d_1": F.sin(2 * math.pi * at / m), "d_2": F.cos(2 * math.pi * at / m)})


def softsign(x: Column) -> Column:
    return x / (1 + F.abs(x))


def combine(members: DataFrame, by: list[str], value: str, how: str = "median") -> DataFrame:
    """Members -> one value a group; a null member makes the mean and the median null."""
    whole = F.count(F.lit(1)) == F.count(value)
    agg = {"mean": F.avg(value), "median": F.median(value)}[how]
    return members.groupBy(*by).agg(F.when(whole, agg).alias(value))
