"""The engine's expressions and sums against plain numpy versions, over series of many kinds."""

import math

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from tidecast.functions import arrays as A
from tidecast.functions import nets, stats
from tidecast.operators import design
from tidecast.operators import forecasting as fc

RNG = np.random.default_rng(31)


def wave(n, m, size=10.0):
    return size * np.sin(2 * np.pi * np.arange(n) / m)


SERIES = {
    "season": 100 + wave(90, 12) + RNG.normal(0, 1, 90),
    "noise": 100 + RNG.normal(0, 1, 77),
    "trend": 50 + 2.5 * np.arange(85) + RNG.normal(0, 2, 85),
    "both": 50 + 2.5 * np.arange(96) + wave(96, 12) + RNG.normal(0, 1, 96),
    "walk": RNG.normal(size=120).cumsum(),
    "grows": (100 + 4 * np.arange(84)) * (1 + wave(84, 12, 0.3)) + RNG.normal(0, 1, 84),
    "roots": np.add.accumulate(RNG.normal(0, 4, (40, 12)), 0).ravel(),
    "short": RNG.normal(size=18),
    "tiny": RNG.normal(size=5),
    "flat": np.full(30, 4.0),
    "line": 3.0 * np.arange(40),
}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, [float(v) for v in y], m) for k, y in SERIES.items() for m in (12, 7, 4, 1)], "id string, y array<double>, m int").repartition(4)


def test_averages_and_tests_equal_plain_ones(frame):
    y, m = F.col("y"), F.col("m")
    rows = frame.withColumn("cma", A.centred_average(y, m)).select("*", A.friedman(y, F.col("cma"), m).alias("f"), A.seasonal(y, F.col("cma"), m).alias("s"), A.multiplicative(y, F.col("cma"), m).alias("p"), A.trending(F.col("cma")).alias("t"), A.chi2_tail(A.friedman(y, F.col("cma"), m)["stat"], m - 1).alias("tail")).collect()
    for r in rows:
        y, m = np.array(r.y), r.m
        cma, (whole, stat) = plain.centred_average(y, m), plain.friedman(y, m)
        assert np.allclose(r.cma, cma, rtol=1e-12) and r.f.seasons == whole and r.p == plain.multiplicative(y, cma, m), (r.id, m)
        if r.id not in ("flat", "line"):  # there ties depend on rounding
            assert r.t == plain.trending(cma) and r.s == plain.seasonal(y, m), (r.id, m)
            assert (r.f.stat is None and r.tail is None) if math.isnan(stat) else math.isclose(r.f.stat, stat, rel_tol=1e-9) and math.isclose(r.tail, stats.chi2_tail(stat, m - 1), abs_tol=1e-12)


def test_tails_and_smoothing_equal_plain_ones(spark, frame):
    points = [(x, k) for x in (1e-3, 0.5, 3.84, 11.0, 19.675, 60.0, 400.0, 2000.0) for k in (1, 2, 3, 11, 12, 167)]
    for r in spark.createDataFrame(points, "x double, k int").select("x", "k", A.chi2_tail(F.col("x"), F.col("k")).alias("p"), A.t_tail(F.col("x"), F.col("k")).alias("q")).collect():
        assert math.isclose(r.p, stats.chi2_tail(r.x, r.k), rel_tol=1e-8, abs_tol=1e-13) and math.isclose(r.q, stats.t_tail(r.x, r.k), rel_tol=1e-8, abs_tol=1e-14)
    for r in frame.where("m = 12 and id not in ('flat', 'line')").select("y", A.smoothing_aic(F.col("y"), True).alias("a"), A.smoothing_aic(F.col("y"), False).alias("b")).collect():
        assert np.allclose([r.a, r.b], [plain.smoothing_aic(np.array(r.y), trend) for trend in (True, False)], rtol=1e-7)


SPECS = [
    fc.Spec(),
    fc.Spec(strict=False),
    fc.Spec(difforder=(1, 12)),
    fc.Spec(difforder=(0,), select=False, phase=5),
    fc.Spec(periods=(4,), difforder=(1,), keep=(4,), lags=(1, 2, 4)),
    fc.Spec(periods=(7, 30.5), lags=(1, 3), difforder=(0,)),
    fc.Spec(periods=(12,), det_type="trg", difforder=(0,)),
    fc.Spec(periods=(12,), lags=(0,), difforder=(0,)),
    fc.Spec(periods=(2,), difforder=(0,), lags=(1,), strict=False),
]


def same_plan(got, want):
    for c in design.PLAN_NAMES:
        a, b = got[c], want[c]
        if c in ("hidden", "hidden_errors"):
            continue
        if isinstance(b, float) or (isinstance(b, list) and c in ("x_low", "x_high")):
            assert np.allclose(a, b, rtol=1e-12), (got.series_id, c, a, b)
        elif c in ("inputs", "rows"):
            assert a == (b if want["status"] == "ok" else 0), (got.series_id, c, a, b)
        else:
            assert a == b, (got.series_id, c, a, b)


def random_members(plan, spec, reps=2):
    rng = np.random.default_rng(7)
    out = []
    for rep in range(reps):
        layers = nets.random_layers(plan["inputs"], (3, 2), False, False, rng)
        out.append((rep, "logistic", [*layers, rng.normal(size=(3, 1))], rng.normal(size=plan["inputs"]) * 0.1))
    return out


@pytest.mark.parametrize("spec", SPECS, ids=range(len(SPECS)))
def test_plans_designs_forecasts_and_fitted_values_equal_plain_ones(spark, spec):
    used = {k: y for k, y in SERIES.items() if k not in ("flat", "line") or spec.difforder == (1,)}
    rows = [(k, t, float(v)) for k, y in used.items() for t, v in enumerate(y, 1)]
    series = spark.createDataFrame(rows, "series_id string, t int, y double").repartition(3)
    plans = fc.specify(series, spec).cache()
    got = {r.series_id: r for r in plans.collect()}
    want = {k: plain.plan_of(k, y, None, spec) for k, y in used.items()}
    assert set(got) == set(want)
    for k in want:
        same_plan(got[k], want[k])
    check_models(spark, series, plans, {k: (y, None, want[k]) for k, y in used.items()}, spec)


def check_models(spark, series, plans, plain_ones, spec, h=9):
    good = {k: v for k, v in plain_ones.items() if v[2]["status"] == "ok"}
    members = {k: random_members(p, spec) for k, (_, _, p) in good.items()}
    models = spark.createDataFrame([(k, rep, name, [w.tolist() for w in layers], direct.tolist(), True) for k, own in members.items() for rep, name, layers, direct in own], fc.MODEL)
    seen = {(r.series_id, r.rep): [] for r in models.collect()}
    for r in fc.predict(series, plans, models, spec, h).orderBy("h").collect():
        seen.setdefault((r.series_id, r.rep), []).append(r.yhat)
    for k, (y, x, p) in plain_ones.items():
        for rep, name, layers, direct in members.get(k, [(0, None, None, None)]):
            expected = plain.path(y, x, p, layers, direct, name, spec, h)
            assert [v is None for v in seen[k, rep]] == [v is None for v in expected], (k, seen[k, rep], expected)
            assert np.allclose([v or 0 for v in seen[k, rep]], [v or 0 for v in expected], rtol=1e-9), k
    back = {}
    for r in fc.fitted(series, plans, models, spec).orderBy("t").collect():
        back.setdefault((r.series_id, r.rep), []).append((r.t, r.y, r.fitted))
    for k, own in members.items():
        y, x, p = good[k]
        z, xs, levels, start = plain.prepared(y, x, p, spec)
        matrix, target = plain.design(z, xs, p, start)
        rows = design.design(design.planned(series.where(F.col("series_id") == k), plans), spec.phase, "series_id").orderBy("at").collect()
        assert np.allclose([r.x for r in rows], matrix, atol=1e-12) and np.allclose([r.target for r in rows], target)
        for rep, name, layers, direct in own:
            v = plain.unscaled(nets.forward(matrix, layers, direct, name), p["low"], p["high"])
            for level, lag in zip(levels[-2::-1], p["difforder"][::-1], strict=True):
                v = v + level[-len(v) - lag : -lag]
            assert np.allclose([f for _, _, f in back[k, rep]], v, rtol=1e-9) and [t for t, _, _ in back[k, rep]] == list(range(len(y) - len(v) + 1, len(y) + 1))


@pytest.mark.parametrize("difforder", [(0,), (1,), (1, 4)])
def test_regressors_equal_plain_ones(spark, difforder):
    n, h = 80, 5
    x = np.c_[RNG.normal(size=n + h), 100 + RNG.normal(size=n + h).cumsum()]
    y = 2 * x[:n, 0] + np.r_[0, x[: n - 1, 1]] + wave(n, 4)
    spec = fc.Spec(periods=(4,), lags=(1, 2), xreg_lags=((0, 1), (1, 3)), difforder=difforder, xreg_keep=((1,),))
    series = spark.createDataFrame([("a", t + 1, float(y[t]) if t < n else None, x[t].tolist()) for t in range(n + h)], "series_id string, t int, y double, x array<double>").repartition(3)
    plans = fc.specify(series, spec).cache()
    want = plain.plan_of("a", y, x, spec)
    same_plan(plans.first(), want)
    assert 1 in want["xreg_lags"][0]
    check_models(spark, series, plans, {"a": (y, x, want)}, spec)


def test_backward_selection_by_sweeps_equals_refits():
    for trial in range(40):
        n, p = int(RNG.integers(20, 90)), int(RNG.integers(3, 12))
        x = RNG.normal(size=(n, p))
        if trial % 3 == 0:
            x[:, -1] = x[:, 0] - 2 * x[:, 1]
        y = x[:, 0] - 0.4 * x[:, p // 2] + RNG.normal(size=n)
        blocks = [[j] for j in range(p - 2)] + [[p - 2, p - 1]]
        keep = {1} if trial % 2 else set()
        assert stats.swept(stats.moments(x, y), blocks, keep) == plain.backward(x, y, blocks, keep), trial


def test_lasso_paths_meet_their_conditions_and_equal_a_long_descent():
    def descent(g, c, penalty):
        w, size = np.zeros(len(c)), np.diag(g)
        for _ in range(4000):
            before = w.copy()
            for j in np.flatnonzero(size > 1e-14):
                rho = c[j] - g[j] @ w + size[j] * w[j]
                w[j] = np.sign(rho) * max(abs(rho) - penalty, 0) / size[j]
            if np.abs(w - before).max() < 1e-9:
                break
        return w

    for trial in range(100):
        n, p, k = int(RNG.integers(8, 80)), int(RNG.integers(2, 12)), int(RNG.integers(2, 60))
        x = RNG.uniform(-0.8, 0.8, (n, p))
        y = np.tanh(x[:, 0] + 0.3 * RNG.normal(size=n))
        z = nets.hidden_output(x, nets.random_layers(p, (k,), False, False, RNG), "logistic")  # often more neurons than rows
        if trial % 4 == 0:
            z = np.hstack([z, z[:, :1], 2 * z[:, :1], np.ones((n, 1)), -z[:, 1:2]])
        m = stats.moments(z, y)
        _, _, _, g, c, vy = stats.centred(m)
        penalties = np.abs(c).max() * np.geomspace(1, 1e-4, 20)
        w = stats.lasso_path(m[None], penalties)[0][:, 1:]
        assert stats.off_optimum(g, c, np.ones(len(c)), penalties, w) < 1e-7 * penalties[0]
        for i in (4, 11):
            cost = lambda v, i=i: 0.5 * v @ g @ v - c @ v + penalties[i] * np.abs(v).sum()
            assert cost(w[i]) <= cost(descent(g, c, penalties[i])) + 1e-9 * vy
