"""Seasonal unit roots of a series, free of its trend or average."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Five per cent points of the von Mises limit for 1 to 12 degrees of freedom (Canova and Hansen 1995, table 1). Fixed values.
CRITICAL = (0.470, 0.749, 1.01, 1.24, 1.47, 1.68, 1.90, 2.11, 2.32, 2.54, 2.75, 2.96)


def seasonal_root(y: np.ndarray, m: int) -> bool:
    """Canova and Hansen's test: whether the seasonal pattern moves, judged from partial sums of its regression residuals.

    The long-run variance takes period * (n / 100)^(1/4) lags, which makes the test cautious on short series: of simulated
    monthly seasonal walks it found all with 40 seasons and none with 20.
    """
    n = len(y)
    if n < 2 * m + 5:
        return False
    t = np.arange(1, n + 1)
    waves = [f(2 * math.pi * j * t / m) for j in range(1, m // 2 + 1) for f in ((np.cos, np.sin) if 2 * j != m else (np.cos,))]
    z = np.column_stack(waves)
    x = np.hstack([np.ones((n, 1)), z])
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    f = z * e[:, None]
    omega = f.T @ f / n
    window = round(m * (n / 100) ** 0.25)
    for k in range(1, min(window, n - 1) + 1):
        g = f[k:].T @ f[:-k] / n
        omega += (1 - k / (window + 1)) * (g + g.T)
    sums = f.cumsum(0)
    stat = float(np.trace(np.linalg.pinv(omega, hermitian=True) @ (sums.T @ sums))) / n**2
    p = z.shape[1]
    return stat > (CRITICAL[p - 1] if p <= len(CRITICAL) else 0.269 * (p + 1) ** 0.928)


def roots_of(free: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([v is not None and seasonal_root(np.asarray(v, float), int(k)) for v, k in zip(free, m, strict=True)])


def seasonal_roots(free: str, m: str) -> Column:
    """seasonal_root of each array; false where there is none."""
    return pandas_udf(roots_of, "boolean")(free, m)
