"""From raw events to forecasts in a stream: events become regular steps by watermark and window, and each series' output weights follow the data.

A step is closed once the watermark has passed its end; events that come later are left out, which Spark counts. A step without events
gives no row; where the series goes on it is filled with 0 or the last value. Output weights are those of recursive least squares
with forgetting, so after every step they are the exact minimum of the weighted squared errors so far plus a vanishing ridge, and state
is as large as the square of the features, whatever the stream's length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidecast.functions import nets

SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}
STATE = "t bigint, tail array<double>, weights array<double>, spread array<double>"
OUT = "series_id string, t bigint, y double, filled boolean, expected double, ahead array<double>"


def steps(events: DataFrame, series_id: str, ts: str, value: str, grain: str, late: str) -> DataFrame:
    """(series_id, t, ts, y): sums of value by series and grain, in append mode, once the watermark (`late` behind the latest event) is past.

    t counts grains from 1970 in UTC (weeks from its first Monday). Null ids and times are left out; a null value adds nothing.
    """
    if grain not in SECONDS:
        raise ValueError(f"grain is one of {', '.join(SECONDS)}")
    shift = 4 * 86400 if grain == "week" else 0
    rows = events.select(F.col(series_id).cast("string").alias("series_id"), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")).where("series_id is not null and ts is not null")
    window = F.window("ts", f"{SECONDS[grain]} seconds", startTime=f"{shift} seconds")
    sums = rows.withWatermark("ts", late).groupBy(window.alias("w"), "series_id").agg(F.sum("v").alias("y"))
    return sums.select("series_id", ((F.unix_seconds("w.start") - shift) / SECONDS[grain]).cast("bigint").alias("t"), F.col("w.start").alias("ts"), "y")


def features(x: np.ndarray, layer: np.ndarray | None) -> np.ndarray:
    return np.concatenate([[1.0], x, nets.hidden_output(x[None], [layer], "softsign")[0] if layer is not None else []])


def follow(stream: DataFrame, plans: DataFrame, hidden: int = 0, h: int = 1, forget: float = 0.99, ridge: float = 1e-3, fill: str = "zero", gap: int = 1000, seed: int = 42) -> DataFrame:
    """stream(series_id, t, y) -> (series_id, t, y, filled, expected, ahead), a row for each step of a series with a plan, in append mode.

    plans: (series_id, lags, low, high). Inputs are the lagged values, scaled from [low, high] to [-0.8, 0.8], and hidden random
    neurons of them. expected: what the weights said before they saw the step (null until all lags are there); ahead: the next h
    steps, each on the ones before. A missing step is filled (`zero`, or `last` value) and learned from as any other; after
    more than `gap` of them the series starts over but keeps its weights. Steps at or before the last one seen are left out.
    """
    if fill not in ("zero", "last"):
        raise ValueError("fill is zero or last")
    known = plans.select(F.col("series_id").cast("string").alias("series_id"), "lags", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")).where("size(lags) > 0 and low < high")
    rows = stream.select("series_id", F.col("t").cast("bigint").alias("t"), F.col("y").cast("double").alias("y")).where("y is not null and t is not null").join(known, "series_id")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).drop_duplicates("t").sort_values("t")
        lags, low, high = np.asarray(pdf["lags"].iloc[0], int), float(pdf["low"].iloc[0]), float(pdf["high"].iloc[0])
        layer = nets.random_layer(len(lags), hidden, False, np.random.default_rng([seed, zlib.crc32(str(key[0]).encode())])) if hidden else None
        size, need = 1 + len(lags) + hidden, int(lags.max())
        if state.exists:
            last, tail, w, p = state.get
            tail, w, p = list(tail), np.array(w), np.array(p).reshape(size, size)
        else:
            last, tail, w, p = None, [], np.zeros(size), np.eye(size) / ridge
        scaled = lambda v: 1.6 * (v - low) / (high - low) - 0.8
        inputs = lambda z: features(np.array([z[-k] for k in lags]), layer)
        out = []

        def take(t: int, y: float, filled: bool) -> None:
            nonlocal tail, w, p
            z, expected = scaled(y), None
            if len(tail) == need:
                f = inputs(tail)
                expected = (float(w @ f) + 0.8) / 1.6 * (high - low) + low
                gain = p @ f / (forget + f @ p @ f)
                w = w + gain * (z - w @ f)
                p = (p - np.outer(gain, f @ p)) / forget
                p = (p + p.T) / 2
            tail = [*tail, z][-need:]
            path, ahead = list(tail), None
            if len(tail) == need:
                for _ in range(h):
                    path.append(float(w @ inputs(path)))
                ahead = [(v + 0.8) / 1.6 * (high - low) + low for v in path[-h:]]
            out.append((key[0], t, y, filled, expected, ahead))

        for t, y in pdf[["t", "y"]].itertuples(index=False):
            if last is not None and t <= last:
                continue
            if last is not None and t - last - 1 > gap:
                tail = []
            elif last is not None:
                for missing in range(int(last) + 1, int(t)):
                    before = (tail[-1] + 0.8) / 1.6 * (high - low) + low
                    take(missing, 0.0 if fill == "zero" else before, True)
            take(int(t), float(y), False)
            last = int(t)
        if last is not None:
            state.update((last, [float(v) for v in tail], w.tolist(), p.ravel().tolist()))
        yield pd.DataFrame(out, columns=["series_id", "t", "y", "filled", "expected", "ahead"])

    return rows.groupBy("series_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
