"""Plain numpy versions of what the engine does by expressions and sums, one series at a time: the tests hold the engine against them."""

import math
import zlib

import numpy as np

from tidecast.functions import nets, stats
from tidecast.functions.stats import chi2_tail, t_tail
from tidecast.functions.unitroots import seasonal_root


def centred_average(y: np.ndarray, m: int) -> np.ndarray:
    """Centred moving average of m steps (2 x m where m is even); both ends hold the nearest whole average."""
    if m <= 1 or len(y) < m + (m % 2 == 0):
        return y.copy() if m <= 1 else np.full(len(y), y.mean())
    kernel = np.ones(m) / m if m % 2 else np.r_[0.5, np.ones(m - 1), 0.5] / m
    inner = np.convolve(y, kernel, "valid")
    half = len(kernel) // 2
    return np.r_[np.full(half, inner[0]), inner, np.full(half, inner[-1])]


def friedman(y: np.ndarray, m: int) -> tuple[int, float]:
    """(whole seasons, statistic) of Friedman's test over the de-trended series; no statistic (nan) with fewer than two seasons."""
    whole = len(y) // m if m > 1 else 0
    if whole < 2:
        return whole, math.nan
    cma = centred_average(y, m)
    v = (y / cma if y.min() > 0 else y - cma)[: whole * m].reshape(whole, m)
    ranks = np.array([(np.searchsorted(s := np.sort(row), row, "left") + np.searchsorted(s, row, "right") + 1) / 2 for row in v])
    spread = ((ranks - (m + 1) / 2) ** 2).sum()
    return whole, float((m - 1) * ((ranks.sum(0) - whole * (m + 1) / 2) ** 2).sum() / spread) if spread else math.nan


def seasonal(y: np.ndarray, m: int, level: float = 0.05) -> bool:
    """Whether Friedman's test finds a season; false where there is no statistic."""
    _, stat = friedman(y, m)
    return not math.isnan(stat) and chi2_tail(stat, m - 1) <= level


def smoothing_aic(y: np.ndarray, trend: bool) -> float:
    """n log SSE + 2k of exponential smoothing with additive errors, with or without an additive trend.

    The errors are linear in the starting states, so those are solved exactly on a grid of smoothing weights, narrowed twice.
    """
    lo, hi = np.array([0.01, 0.01]), np.array([0.99, 0.99])
    best = math.inf
    for _ in range(3):
        a = np.linspace(lo[0], hi[0], 13)
        a, share = (g.ravel() for g in np.meshgrid(a, np.linspace(lo[1], hi[1], 9) if trend else [0.0]))
        b = a * share
        # columns: the path from zero states, and its derivatives in the starting level and slope
        level, slope = np.zeros((3, len(a))), np.zeros((3, len(a)))
        level[1], slope[2] = 1.0, 1.0
        cross = np.zeros((3, 3, len(a)))
        for v in y:
            e = -(level + slope if trend else level)
            e[0] += v
            cross += e[:, None] * e
            level, slope = -e + a * e, slope + b * e
            level[0] += v
        k = 2 if trend else 1
        g, c = np.moveaxis(cross[1 : 1 + k, 1 : 1 + k], 2, 0), cross[1 : 1 + k, 0].T
        start = np.linalg.solve(g + 1e-12 * np.trace(g, axis1=1, axis2=2)[:, None, None] * np.eye(k), c[:, :, None])[:, :, 0]
        sse = np.maximum(cross[0, 0] - (c * start).sum(1), 1e-12 * (y @ y) + 1e-300)
        at = int(sse.argmin())
        best = min(best, float(sse[at]))
        width = (hi - lo) / 8
        mid = np.array([a[at], share[at] if trend else 0.5])
        lo, hi = np.clip(mid - width, 0.001, 0.998), np.clip(mid + width, 0.002, 0.999)
    return len(y) * math.log(best) + 2 * (4 if trend else 2)


def trending(cma: np.ndarray) -> bool:
    """Whether smoothing with a trend explains the centred average better, by AIC."""
    if len(cma) < 4 or cma.min() == cma.max():
        return False
    z = (cma - cma.mean()) / cma.std()
    return smoothing_aic(z, False) > smoothing_aic(z, True)


def multiplicative(y: np.ndarray, cma: np.ndarray, m: int, level: float = 0.05) -> bool:
    """Whether the seasons' ranges grow with their level: positive correlation over whole seasons."""
    whole = len(y) // m
    if y.min() <= 0 or whole < 3:
        return False
    r = (y - cma)[: whole * m].reshape(whole, m)
    size, height = r.max(1) - r.min(1), cma[: whole * m].reshape(whole, m).mean(1)
    if size.std() == 0 or height.std() == 0:
        return False
    c = float(np.corrcoef(size, height)[0, 1])
    return c > 0 and t_tail(c * math.sqrt((whole - 2) / max(1 - c * c, 1e-300)), whole - 2) <= level


def difference_orders(y: np.ndarray, m: int, strict: bool = True) -> tuple[int, ...]:
    """1 where the series trends, then m where its season has a unit root.

    strict: a seasonal difference is taken only together with the one for trend; otherwise it may stand alone.
    """
    cma = centred_average(y, m)
    trend, season = trending(cma), False
    if seasonal(y, m):
        ratio = y.min() > 0 and (len(y) / m < 3 or multiplicative(y, cma, m))
        season = seasonal_root(y / cma if ratio else y - cma, m)
    if season and not trend and strict:
        return ()
    return (1,) * trend + (m,) * season


def aic(x: np.ndarray, y: np.ndarray) -> float:
    """n log(RSS/n) + 2k of least squares with an intercept in x."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = max(float(((y - x @ beta) ** 2).sum()), 1e-300)
    return len(y) * math.log(rss / len(y)) + 2 * x.shape[1]


def backward(x: np.ndarray, y: np.ndarray, blocks: list[list[int]], keep: set[int] = frozenset()) -> list[int]:
    """Blocks of columns that backward selection by AIC leaves; those in keep are never dropped."""
    held = list(range(len(blocks)))
    one = np.ones((len(y), 1))
    score = lambda own: aic(np.hstack([one, *[x[:, blocks[b]] for b in own]]) if own else one, y)
    now = score(held)
    while True:
        tries = [(score([b for b in held if b != out]), out) for out in held if out not in keep]
        if not tries or min(tries)[0] >= now:
            return held
        now, out = min(tries)
        held.remove(out)


def ladder(y: np.ndarray, order: tuple[int, ...]) -> list[np.ndarray]:
    """y and its successive differences, each shorter than the one before."""
    out = [y]
    for k in order:
        out.append(out[-1][k:] - out[-1][:-k])
    return out


def scaled(v: np.ndarray, low, high) -> np.ndarray:
    return 1.6 * (v - low) / np.where(np.asarray(high) > low, np.subtract(high, low), 1.0) - 0.8


def unscaled(v: np.ndarray, low: float, high: float) -> np.ndarray:
    return (v + 0.8) / 1.6 * (high - low) + low


def seasons(at: np.ndarray, m: float, kind: str) -> list[np.ndarray]:
    """Dummy columns of the steps at (from 0): m - 1 indicators, or the first sine and cosine."""
    if kind == "bin":
        return [(at % m == s).astype(float) for s in range(1, int(m))]
    angle = 2 * np.pi * (at % m) / m
    return [np.cos(angle)] if m == 2 else [np.sin(angle), np.cos(angle)]


def blocks_of(z: np.ndarray, x: np.ndarray | None, plan: dict, start: int, first: int, last: int) -> list[list[np.ndarray]]:
    """Input columns for steps first..last-1 of z, in blocks: each lag, each lag of each regressor, each period's dummies."""
    out = [[z[first - k : last - k]] for k in plan["lags"]]
    out += [[x[first - k : last - k, i]] for i, ks in enumerate(plan["xreg_lags"]) for k in ks]
    return out + [seasons(np.arange(first, last) + start, m, plan["det_type"]) for m in plan["periods"]]


def depth(plan: dict) -> int:
    return max([*plan["lags"], *(k for ks in plan["xreg_lags"] for k in ks)], default=0)


def design(z: np.ndarray, x: np.ndarray | None, plan: dict, start: int) -> tuple[np.ndarray, np.ndarray]:
    first = depth(plan)
    blocks = blocks_of(z, x, plan, start, first, len(z))
    return np.column_stack([c for b in blocks for c in b]), z[first:]


def rng_of(spec, series: str, *more: int) -> np.random.Generator:
    return np.random.default_rng([spec.seed, zlib.crc32(str(series).encode()), *more])


def prepared(y: np.ndarray, x: np.ndarray | None, plan: dict, spec) -> tuple[np.ndarray, np.ndarray | None, list[np.ndarray], int]:
    """(z, scaled regressors on z's steps, levels of differences, steps before z)."""
    shift = sum(plan["difforder"])
    levels = ladder(y, plan["difforder"])
    if x is not None and len(plan["x_low"]):
        x = scaled(x[shift:], plan["x_low"], plan["x_high"])
    return scaled(levels[-1], plan["low"], plan["high"]), x, levels, shift + spec.phase


def select(z: np.ndarray, x: np.ndarray | None, plan: dict, spec, start: int, rng: np.random.Generator) -> tuple[dict, str]:
    """The plan with the inputs that backward selection leaves; by lasso where there are too few steps. Waves always stay."""
    first = depth(plan)
    blocks = blocks_of(z, x, plan, start, first, len(z))
    names = [("y", 0, k) for k in plan["lags"]] + [("x", i, k) for i, ks in enumerate(plan["xreg_lags"]) for k in ks] + [("d", 0, m) for m in plan["periods"]]
    matrix, target = np.column_stack([c for b in blocks for c in b]), z[first:]
    ends = np.cumsum([len(b) for b in blocks])
    columns = [list(range(e - len(b), e)) for b, e in zip(blocks, ends, strict=True)]
    kept = {j for j, (kind, i, k) in enumerate(names) if (kind == "y" and k in spec.keep) or (kind == "x" and i < len(spec.xreg_keep) and k in spec.xreg_keep[i])}
    warning = ""
    if len(target) > matrix.shape[1] + 2:
        held = backward(matrix, target, columns, kept)
    else:
        fold = rng.permutation(len(target)) % min(5, len(target))
        w = stats.cross_validated([stats.moments(matrix[fold == f], target[fold == f]) for f in range(fold.max() + 1)], stats.lasso_path, rule=spec.penalty)
        held, warning = [j for j, own in enumerate(columns) if (w[1 + np.array(own)] != 0).any()], "selected by lasso"
    left = [names[j] for j in held]
    new = plan | {
        "lags": [k for kind, _, k in left if kind == "y"],
        "xreg_lags": [[k for kind, j, k in left if kind == "x" and j == i] for i in range(len(plan["xreg_lags"]))],
        "periods": plan["periods"] if plan["det_type"] == "trg" else [m for kind, _, m in left if kind == "d"],
    }
    if not new["lags"]:
        if not plan["periods"] and not any(new["xreg_lags"]):
            new["lags"], warning = [1], "no inputs left: the last value is used"
        elif spec.strict or not (new["periods"] or any(new["xreg_lags"])):
            new["lags"] = plan["lags"]
        if not new["lags"] and not new["periods"] and not any(new["xreg_lags"]):
            new["lags"], warning = [1], "no inputs left: the last value is used"
    return new, warning


def plan_of(key: str, y: np.ndarray, x: np.ndarray | None, spec) -> dict:
    width = 0 if x is None else x.shape[1]
    plan = {"series_id": key, "status": "ok", "warning": "", "season": float(max(spec.periods)), "difforder": [], "lags": list(spec.candidates), "xreg_lags": [], "periods": [], "det_type": None, "low": None, "high": None, "x_low": [], "x_high": [], "inputs": 0, "rows": 0, "hidden": None, "hidden_errors": None}
    stop = lambda why, **more: plan | more | {"status": why}
    if spec.xreg_lags is not None and len(spec.xreg_lags) != width:
        return stop("regressors and their lags don't match")
    if width and len(x) < len(y):
        return stop("regressors are shorter than the series")
    plan["xreg_lags"] = [list(ks) for ks in spec.xreg_lags] if spec.xreg_lags is not None else [list(spec.candidates)] * width
    if not len(y) or not np.isfinite(y).all() or (width and not np.isfinite(x).all()):
        return stop("too short or with gaps")
    if y.min() == y.max():
        return stop("constant", low=float(y[0]), high=float(y[0]), lags=[], xreg_lags=[])
    order = difference_orders(y, spec.m, spec.strict) if spec.difforder is None else tuple(spec.difforder)
    plan["difforder"] = [] if 0 in order else list(order)
    shift = sum(plan["difforder"])
    if len(y) - shift <= depth(plan) + 2:
        return stop("too short or with gaps")
    if spec.dummies and spec.m > 1 and (len(spec.periods) > 1 or spec.m not in plan["difforder"]) and seasonal(y, spec.m):
        plan["periods"] = [float(m) for m in spec.periods]
        whole = len(spec.periods) == 1 and spec.periods[0] == spec.m <= 12
        plan["det_type"] = spec.det_type if spec.det_type != "auto" else ("bin" if whole else "trg")
    d = ladder(y, plan["difforder"])[-1]
    plan["low"], plan["high"] = float(d.min()), float(d.max())
    if plan["low"] == plan["high"]:
        return stop("constant", lags=[], xreg_lags=[], periods=[])
    if not plan["lags"] and not any(plan["xreg_lags"]) and not plan["periods"]:
        return stop("no inputs")
    if width:
        plan["x_low"], plan["x_high"] = x[shift:].min(0).tolist(), x[shift:].max(0).tolist()
    z, x, _, start = prepared(y, x, plan, spec)
    if spec.select:
        plan, plan["warning"] = select(z, x, plan, spec, start, rng_of(spec, key))
    matrix, target = design(z, x, plan, start)
    plan["inputs"], plan["rows"] = matrix.shape[1], len(target)
    return plan


def path(y: np.ndarray, x: np.ndarray | None, plan: dict, layers, direct, activation, spec, h: int) -> list[float | None]:
    if plan["status"] not in ("ok", "constant") or (plan["status"] == "ok" and layers is None):
        return [None] * h
    z, x, levels, start = prepared(y, x, plan, spec)
    if plan["status"] == "constant":
        ahead = np.full(h, plan["low"])
    else:
        n, lagged = len(z), [k for ks in plan["xreg_lags"] for k in ks]
        known = h if not lagged else min(h, (0 if x is None else len(x)) - n + min(lagged))
        z = np.append(z, np.full(h, np.nan))
        for i in range(n, n + max(known, 0)):
            row = [c for b in blocks_of(z, x, plan, start, i, i + 1) for c in b]
            z[i] = nets.forward(np.column_stack(row), layers, direct, activation)[0]
        ahead = unscaled(z[n:], plan["low"], plan["high"])
    for level, k in zip(levels[-2::-1], plan["difforder"][::-1], strict=True):
        whole = np.append(level[-k:], ahead)
        for i in range(k, len(whole)):
            whole[i] += whole[i - k]
        ahead = whole[k:]
    return [float(v) if np.isfinite(v) else None for v in ahead]
