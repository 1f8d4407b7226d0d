import datetime
import math
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from tidecast.functions import nets, stats, unitroots
from tidecast.functions import transforms as T
from tidecast.operators import forecasting as fc
from tidecast.operators import hierarchy, perceptron, regression, reports
from tidecast.plans import ensembles, native
from tidecast.sources.series import series_from
from tidecast.streaming import scoring


def frame(spark, **series):
    return spark.createDataFrame([(k, t, float(v)) for k, y in series.items() for t, v in enumerate(y, 1)], "series_id string, t int, y double")


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("series_id", "t").select(*columns).collect()]


def test_gaps_are_filled_and_the_partial_end_is_left_out(spark):
    day = datetime.datetime
    table = spark.createDataFrame([("a", day(2020, 1, 5), 1.0), ("a", day(2020, 1, 9), 2.5), ("a", day(2020, 3, 1), 4.0), ("b", day(2020, 4, 2), 9.0)], "id string, at timestamp_ntz, v double")
    got = [(r.series_id, r.t, r.y) for r in series_from(table, "id", "at", "v", "month", trim=1).orderBy("series_id", "t").collect()]
    assert got == [("a", 1, 3.5), ("a", 2, 0.0), ("a", 3, 4.0), ("b", 1, 0.0), ("b", 2, 0.0), ("b", 3, 0.0)]


def test_scaling_goes_to_the_range_and_back_and_a_constant_is_null(spark):
    s = T.with_scaled(frame(spark, a=[1, 5, 3], c=[2, 2]))
    assert rows(s, "y_sc") == [(-0.8,), (0.8,), (0.0,), (None,), (None,)]
    back = rows(s.where("series_id = 'a'").withColumn("b", T.unscale(F.col("y_sc"), F.col("low"), F.col("high"))), "b")
    assert [round(b[0], 9) for b in back] == [1, 5, 3]


def test_differences_lags_and_averages(spark):
    y = [float(x * x) for x in range(1, 16)]
    d = T.difference(frame(spark, a=y), [1, 2])
    assert [r[0] for r in rows(d, "d2")][3:] == [4.0] * 12
    assert len(rows(T.with_lags(frame(spark, a=y), [1, 3]), "lag_1", "lag_3")) == 12
    cma = [r[0] for r in rows(T.centred_average(frame(spark, a=y), 4), "cma")]
    want = [(0.5 * y[i - 2] + y[i - 1] + y[i] + y[i + 1] + 0.5 * y[i + 2]) / 4 for i in range(2, 13)]
    assert cma[:2] == [None, None] and cma[-2:] == [None, None] and np.allclose(cma[2:-2], want)


def test_a_null_member_makes_mean_and_median_null_but_not_the_mode(spark):
    m = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, None), (2, 4.0), (2, 6.0), (2, 20.0)], "h int, yhat double")
    for how, want in (("mean", [None, 10.0]), ("median", [None, 6.0])):
        assert [r.yhat for r in fc.ensemble(m, ["h"], how=how).orderBy("h").collect()] == want
    mode = [r.yhat for r in fc.ensemble(m, ["h"], how="mode").orderBy("h").collect()]
    assert 0.9 <= mode[0] <= 2.1 and 3 <= mode[1] <= 7


def test_tails_and_selection():
    assert math.isclose(stats.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.chi2_tail(19.67513757268249, 11), 0.05, rel_tol=1e-9)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = 3 * x[:, 1] - 2 * x[:, 3] + 0.01 * rng.normal(size=200)
    held = plain.backward(x, y, [[j] for j in range(5)])
    assert {1, 3} <= set(held)
    assert 0 in plain.backward(x, y, [[j] for j in range(5)], {0})
    m = stats.moments(x, y)[None]
    assert set(np.flatnonzero(stats.lasso_path(m, np.array([0.5]))[0, 0, 1:])) == {1, 3}
    exact = np.linalg.lstsq(np.hstack([np.ones((200, 1)), x]), y, rcond=None)[0]
    assert np.allclose(stats.ridge_path(m, np.array([1e-12]))[0, 0], exact, atol=1e-6)
    assert np.allclose(stats.lasso_path(m, np.array([1e-12]))[0, 0], exact, atol=1e-3)
    w, p = stats.least_squares(m[0])
    assert np.allclose(w, exact, atol=1e-6) and p[1] < 1e-9 and p[3] < 1e-9
    w, _ = stats.least_squares(stats.moments(np.hstack([x, x[:, :1] + x[:, 1:2]]), y), step=True)
    assert w[-1] == 0 and abs(w[2] - 3) < 0.01
    assert math.isclose(stats.t_tail(2.2281388519649385, 10), 0.05, rel_tol=1e-8) and math.isclose(stats.t_tail(12.706204736432095, 1), 0.05, rel_tol=1e-8)


def test_the_density_width_solves_its_equation_and_the_mode_is_where_the_values_are():
    v = np.concatenate([np.random.default_rng(3).normal(0, 1, 60), np.random.default_rng(4).normal(9, 0.2, 100)])
    assert abs(stats.density_mode(v) - 9) < 0.3 and 0 < stats.bandwidth(v) < v.std()
    assert stats.density_mode([2.0, 2.0]) == 2.0


def test_differences_and_dummies_are_found():
    t, rng = np.arange(120), np.random.default_rng(6)
    wave = 10 * np.sin(2 * np.pi * t / 12)
    noise = rng.normal(0, 1, 120)
    assert plain.seasonal(100 + wave + noise, 12) and not plain.seasonal(100 + noise, 12) and not plain.seasonal(noise, 1)
    assert plain.difference_orders(100 + wave + noise, 12) == ()
    assert 1 in plain.difference_orders(100 + 3.0 * t + noise, 12)
    walk = np.zeros(480)
    for i in range(480):
        walk[i] = (walk[i - 12] if i >= 12 else 20 * np.sin(i)) + rng.normal(0, 4)
    assert unitroots.seasonal_root(walk, 12) and not unitroots.seasonal_root(wave + noise, 12)
    assert 12 in plain.difference_orders(walk, 12, strict=False)
    assert np.allclose(plain.centred_average(np.arange(20.0), 4)[2:-2], np.arange(2, 18))


def test_resilient_propagation_learns_and_dead_nodes_go():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (150, 2))
    y = np.sin(2 * x[:, 0]) * x[:, 1]
    for hidden in ((6,), (6, 4)):
        layers, settled = nets.mlp(x, y, hidden, rng)
        assert settled in (True, False) and ((nets.forward(x, layers, (), "logistic") - y) ** 2).mean() < 0.1 * y.var()
    assert not nets.mlp(x, y, (6,), rng, steps=3)[1]
    elm = nets.Elm(2, 150, (30,), "lasso", True, rng)
    elm.add(x[:100], y[:100])
    elm.add(x[100:], y[100:])
    layers, direct = elm.solve()
    assert layers[0].shape[1] + 1 == len(layers[1]) and len(direct) == 2 and (layers[1][1:] != 0).all()
    w = nets.random_layer(5, 4, True, rng)
    assert np.allclose(w.T @ w, np.eye(4))


@pytest.mark.parametrize("kind", ["ridge", "ls", "step", "lasso"])
def test_a_seasonal_series_with_trend_is_carried_on(spark, kind):
    y = [10 + 0.5 * t + 4 * math.sin(2 * math.pi * t / 12) for t in range(1, 97)]
    s, spec = frame(spark, a=y[:84], flat=[3.0] * 84, short=[1.0, 2.0]), fc.Spec(type=kind, hidden=10, direct=True, reps=3, difforder=(1,), barebone=True)
    plans = fc.specify(s, spec).cache()
    assert {r.series_id: r.status for r in plans.collect()} == {"a": "ok", "flat": "constant", "short": "too short or with gaps"}
    models = fc.fit(s, plans, spec).cache()
    got = {(r.series_id, r.h): r.yhat for r in fc.ensemble(fc.predict(s, plans, models, spec), ["series_id", "h"]).collect()}
    assert np.allclose([got["a", h] for h in range(1, 13)], y[84:], atol=1.5)
    assert [got["flat", h] for h in (1, 12)] == [3.0, 3.0] and got["short", 1] is None and len(got) == 36
    f = fc.residuals(s, fc.fitted(s, plans, models, spec), spec)
    assert f.count() == 170 and f.where("series_id = 'a' and abs(residual) > 1").count() == 0
    again = fc.reuse(s, plans, spec, frozen=True)
    assert sorted(map(str, again.select("series_id", "low", "lags").collect())) == sorted(map(str, plans.select("series_id", "low", "lags").collect()))


def test_regressors_are_used_and_a_missing_future_is_null(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=90)
    y = 5 + 2 * x + np.r_[0, -1.5 * x[:-1]]
    rows = [("a", t + 1, float(y[t]) if t < 80 else None, [float(x[t])]) for t in range(88)]
    s = spark.createDataFrame(rows, "series_id string, t int, y double, x array<double>")
    spec = fc.Spec(periods=(1,), lags=(0,), xreg_lags=((0, 1, 2),), difforder=(0,), type="ls", hidden=4, direct=True, reps=2, barebone=True)
    plans = fc.specify(s, spec).cache()
    assert plans.first().xreg_lags == [[0, 1]] and plans.first().lags == []
    got = [r.yhat for r in fc.ensemble(fc.predict(s, plans, fc.fit(s, plans, spec), spec, 10), ["series_id", "h"]).orderBy("h").collect()]
    assert np.allclose(got[:8], y[80:88], atol=0.05) and got[8:] == [None, None]
    assert fc.specify(s, fc.Spec(xreg_lags=())).first().status == "regressors and their lags don't match"


def test_hidden_sizes_come_from_the_data(spark):
    y = list(np.sin(np.arange(70) / 3) + np.random.default_rng(1).normal(0, 0.05, 70))
    for how, folds in (("cv", "random"), ("valid", "time"), ("cv", "time"), ("elm", "random")):
        spec = fc.Spec(kind="mlp", periods=(4,), lags=(1, 2), difforder=(0,), hidden_type=how, hidden_max=2, reps=2, folds=folds)
        (size,) = fc.specify(frame(spark, a=y), spec).first().hidden
        assert 1 <= size <= (2 if how != "elm" else 4)


def test_two_seasons_take_waves_and_plans_are_kept_or_refused(spark):
    t = np.arange(300)
    y = 3 * np.sin(2 * np.pi * t / 7) + 2 * np.cos(2 * np.pi * t / 30.5) + np.random.default_rng(2).normal(0, 0.1, 300)
    spec = fc.Spec(periods=(7, 30.5), lags=(1,), difforder=(0,), type="ridge", reps=2)
    s = frame(spark, a=list(y))
    plans = fc.specify(s, spec).cache()
    p = plans.first()
    assert p.det_type == "trg" and p.periods == [7.0, 30.5] and p.inputs == 5
    other = frame(spark, a=list(np.random.default_rng(3).normal(size=300)), b=[1.0, 2.0])
    assert {r.series_id: r.status for r in fc.reuse(other, plans, spec).collect()} == {"a": "the plan's season isn't in the data", "b": "no saved plan"}


def test_reports_agree_with_the_model(spark):
    y = list(np.random.default_rng(5).normal(size=60).cumsum())
    s, spec = frame(spark, a=y), fc.Spec(type="ridge", hidden=(5, 3), reps=2, periods=(4,), lags=(1, 2), direct=True, select=False, difforder=(1,))
    plans = fc.specify(s, spec).cache()
    models = fc.fit(s, plans, spec).cache()
    nodes = reports.network_nodes(plans, models).groupBy("rep", "layer").count().orderBy("rep", "layer").collect()
    width = plans.first().inputs
    assert [r["count"] for r in nodes][:4] == [width, 5, 3, 1]
    edges = {r.layer: r["count"] for r in reports.network_edges(models).where("rep = 0").groupBy("layer").count().collect()}
    assert edges == {0: width, 1: (width + 1) * 5, 2: 18, 3: 4}
    members = fc.predict(s, plans, models, spec)
    assert reports.forecast_lines(s, members, fc.ensemble(members, ["series_id", "h"])).count() == 60 + 8 + 4
    one = reports.summary(plans, models, spark.createDataFrame([("a", 1.23456)], "series_id string, mse double"), spec).first()
    assert (one.differences, one.lags, one.widths, one.mse, one.reps) == ("D1", "1,2", "5,3,1", 1.2346, 2)


def test_regression_on_a_table_uses_all_rows_and_both_ways_of_scoring_agree(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (400, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1]
    rows = [("a" if i % 3 else "b", float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(400)] + [("a", None, 1.0, 2.0), ("c", 1.0, 1.0, None)]
    table = spark.createDataFrame(rows, "grp string, u double, v double, y double").repartition(5)
    for kind in ("ridge", "lasso", "ls", "step"):
        models = regression.fit(table, "grp", "y", ["u", "v"], hidden=15, kind=kind, reps=2, direct=True).cache()
        scored = regression.predict(table, models, "grp", ["u", "v"]).cache()
        assert scored.count() == 402 and scored.where("yhat is null").count() == 2
        assert scored.select(F.avg(F.pow(F.col("yhat") - F.col("y"), 2))).first()[0] < 0.05 * y.var()
    joined = regression.scored_by_join(table, models, "grp", ["u", "v"]).select("u", "v", F.col("yhat_members").alias("b"))
    assert scored.join(joined, ["u", "v"]).where("abs(yhat_members[1] - b[1]) > 1e-9").count() == 0
    assert regression.predict(table, models, "grp", ["u", "v"], "mode").where("yhat is not null").count() == 400


def test_a_logistic_output_gives_probabilities_and_equals_newton(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(-1, 1, (600, 2))
    y = (rng.uniform(size=600) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1])))).astype(float)
    best = (((3 * x[:, 0] - 2 * x[:, 1]) > 0) == (y == 1)).mean()  # of the true odds
    table = spark.createDataFrame([("a", *map(float, r), float(v)) for r, v in zip(x, y)] + [("one", 0.5, 0.5, 1.0)] * 3 + [("a", None, 1.0, 1.0)], "grp string, u double, v double, y double").repartition(4)
    for kind in ("ls", "ridge", "lasso", "step"):
        models = regression.fit(table, "grp", "y", ["u", "v"], hidden=3, kind=kind, reps=2, direct=True, link="logistic").cache()
        scored = regression.predict(table, models, "grp", ["u", "v"]).cache()
        sound = scored.where("grp = 'a' and yhat is not null").select("u", "v", "y", "yhat", "yhat_members").toPandas()
        assert len(sound) == 600 and sound["yhat"].between(0, 1).all() and ((sound["yhat"] > 0.5) == (sound["y"] == 1)).mean() > best - 0.02
        assert {r.yhat for r in scored.where("grp = 'one'").collect()} == {1.0}
        if kind == "ls":
            layer = nets.random_layer(2, 3, False, np.random.default_rng([42, zlib.crc32(b"a"), 0]))
            inputs = sound[["u", "v"]].to_numpy()
            inputs = 2 * (inputs - x.min(0)) / (x.max(0) - x.min(0)) - 1
            a, w = np.hstack([np.ones((600, 1)), nets.hidden_output(inputs, [layer], "softsign"), inputs]), np.zeros(6)
            for _ in range(30):
                p = 1 / (1 + np.exp(-a @ w))
                w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]), a.T @ (sound["y"].to_numpy() - p))
            assert np.allclose(1 / (1 + np.exp(-a @ w)), [m[0] for m in sound["yhat_members"]], atol=1e-3)
    joined = regression.scored_by_join(table, models, "grp", ["u", "v"]).select("u", "v", F.col("yhat_members").alias("b"))
    assert scored.join(joined, ["u", "v"]).where("abs(yhat_members[1] - b[1]) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        regression.fit(table, "grp", "y", ["u"], link="x")


def test_the_penalty_of_a_logistic_output_is_that_of_least_held_out_deviance(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(-1, 1, (400, 4)).round(4)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    table = spark.createDataFrame([("a", *map(float, r), float(v)) for r, v in zip(x, y)], "g string, a double, b double, c double, d double, y double").repartition(3)
    columns = ["a", "b", "c", "d"]
    rows = regression.scaled_rows(table, "g", "y", columns, True, 0.0)[0].toPandas()
    v, target, fold = np.stack(rows["x"]), (rows["y"].to_numpy() + 1) / 2, rows["fold"].to_numpy()
    for kind, path in (("lasso", stats.lasso_path), ("ridge", stats.ridge_path)):
        for rule in ("1se", "min"):
            models = regression.fit(table, "g", "y", columns, hidden=3, kind=kind, reps=1, direct=True, link="logistic", rule=rule).first()
            layer = nets.random_layer(4, 3, False, np.random.default_rng([42, zlib.crc32(b"a"), 0]))
            a = np.hstack([np.ones((400, 1)), nets.hidden_output(v, [layer], "softsign"), v])

            def sums(w):
                full = regression.working(a, 2 * target[:, None] - 1, w)
                even = 400 / (full[:, 0] ** 2).sum()
                return [full[fold == f].T @ full[fold == f] * even for f in range(5)]

            def settled(w, step):
                for _ in range(regression.PASSES):
                    w, before = step(sums(w)), w
                    if before is not None and np.abs(w - before).max() < regression.SETTLED or before is None and np.abs(w).max() < regression.SETTLED:
                        break
                return w

            w = settled(None, lambda m: nets.output_weights(m, kind, rule))
            penalties, paths, out = stats.fold_paths(sums(w), path)
            errors = []
            for f, own in zip(out, paths[1:], strict=True):
                eta = a[fold == f] @ own.T
                errors.append((2 * (np.logaddexp(0, eta) - target[fold == f, None] * eta)).mean(0))
            penalty = penalties[stats.pick(np.array(errors), rule)]
            w = settled(w, lambda m: path(sum(m)[None], np.array([penalty]))[0, 0])
            (m,) = models.members
            got = np.zeros(8)
            alive = [j for j in range(3) if w[1 + j] != 0]
            got[[0, *(1 + j for j in alive)]], got[4:] = m.w_out, m.direct
            assert np.allclose(got, w, atol=1e-3), (kind, rule, got, w)


def test_one_member_without_neurons_is_a_line_and_the_reports_of_a_table_agree(spark):
    table = spark.createDataFrame([(g, float(i), 3.0 * i + 1 + k) for k, g in enumerate("ab") for i in range(50)], "grp string, u double, y double").repartition(3)
    models = regression.fit(table, "grp", "y", ["u"], hidden=0, kind="ls", reps=1, direct=True)
    scored = regression.predict(table, models, "grp", ["u"])
    assert scored.where("abs(yhat - y) > 1e-6 or yhat is null").count() == 0 and models.where("not settled").count() == 0
    points = reports.regression_scatter(scored, "grp", "y")
    assert points.count() == 200 and points.where("rep is null").count() == 100 and points.where("abs(fitted - actual) > 1e-6").count() == 0
    wide = regression.fit(table, "grp", "y", ["u"], hidden=6, kind="lasso", reps=2, rule="min")
    one = reports.regression_summary(wide, spark.createDataFrame([("a", 1.23456)], "g string, mse double")).orderBy("g").first()
    assert (one.g, one.reps, one.inputs, one.direct, one.kind, one.settled, one.mse) == ("a", 2, 1, False, "lasso", True, 1.2346) and 0 <= one.least_neurons <= one.most_neurons <= 6
    assert regression.fit(table.limit(0), "grp", "y", ["u"], hidden=2, kind="ls", reps=1).count() == 0


def test_rows_meet_their_ranges_without_a_shuffle_of_groups(spark):
    """Findings F1, F4, F5, F6: a group's rows were all sent to one task."""
    table = spark.range(0, 8000, 1, 4).select(F.when(F.col("id") % 8 < 5, "a").when(F.col("id") % 8 < 7, "b").otherwise(F.concat(F.lit("c"), F.col("id") % 80)).alias("g"), F.rand(1).alias("y"), F.rand(2).alias("u")).cache()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ready, ends, p = regression.scaled_rows(table, "g", "y", ["u"])
        held = {r.g: r.n for r in ready.withColumn("at", F.spark_partition_id()).groupBy("g").agg(F.countDistinct("at").alias("n")).collect()}
        assert held["a"] == held["b"] == 4 and len(held) == 12
        rows = table.select("g", "y", F.array("u").alias("x"))
        assert {r.g: r.n for r in ends.collect()} == {r.g: r["count"] for r in rows.groupBy("g").count().collect()}
        want = regression.beside_ranges(rows, ends, p).collect()
        for most in (1, 12, 20):  # none, some of the groups' ranges are sent to every task
            got = regression.beside_ranges(rows, ends, p, most)
            assert sorted(got.collect()) == sorted(want)
        spread = regression.beside_ranges(rows, ends, p, 12).withColumn("at", F.spark_partition_id()).groupBy("g").agg(F.countDistinct("at").alias("n"))
        assert {r.g: r.n for r in spread.collect()}["a"] == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_single_block_is_written_without_a_sort_and_several_hold_all_rows(spark):
    """Findings F1, F2: the writer sorted a task's rows by block even where all belong to one."""
    ready = spark.range(0, 400, 1, 4).select(F.concat(F.lit("g"), F.col("id") % 20).alias("g"), F.lit(0).alias("fold"), F.rand(1).alias("y"), F.array(F.rand(2)).alias("x")).cache()
    for blocks in (1, 3):
        written, own = regression.by_blocks(ready, blocks)
        assert ("block" in written.columns) == (blocks > 1) and len(own) == blocks
        groups = [{r.g for r in some.select("g").distinct().collect()} for some in own]
        assert sum(map(len, groups)) == len(set().union(*groups)) == 20
        assert sorted(r for some in own for r in some.select("g", "fold", "y", "x").collect()) == sorted(ready.collect())


def test_inputs_may_be_one_array_and_many(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (300, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1]
    flat = [("a" if i % 3 else "b", *map(float, x[i]), float(y[i])) for i in range(300)]
    table = spark.createDataFrame(flat, "g string, u double, v double, w double, y double").withColumn("x", F.array("u", "v", "w")).repartition(3)
    for kind in ("ridge", "lasso"):
        one, two = (regression.fit(table, "g", "y", x, hidden=8, kind=kind, reps=2, direct=True).cache() for x in (["u", "v", "w"], "x"))
        for a, b in zip(one.orderBy("g").collect(), two.orderBy("g").collect(), strict=True):
            assert (a.g, a.low, a.high) == (b.g, b.low, b.high) and all(m.w_in == n.w_in and np.allclose(m.w_out + m.direct, n.w_out + n.direct, atol=1e-9) for m, n in zip(a.members, b.members, strict=True))
    odd = table.select("g", "y", "x").unionByName(spark.createDataFrame([("a", 1.0, None), ("a", 1.0, [1.0]), ("a", 1.0, [1.0, None, 2.0]), ("a", 1.0, [1.0, float("nan"), 2.0])], "g string, y double, x array<double>"))
    scored = regression.predict(odd, regression.fit(odd, "g", "y", "x", hidden=8, kind="lasso", reps=2, direct=True), "g", "x").cache()
    assert scored.where("yhat is null").count() == 4 and scored.select(F.avg(F.pow(F.col("yhat") - F.col("y"), 2))).first()[0] < 0.05 * y.var()
    joined = regression.scored_by_join(odd, two, "g", "x").select("x", F.col("yhat_members").alias("b"))
    assert joined.where("b is null").count() == 4 and scored.join(joined, "x").where("abs(yhat_members[1] - b[1]) > 1e-9").count() == 0
    wide = rng.normal(size=(150, 2000))
    target = wide @ rng.normal(size=2000)
    many = spark.createDataFrame([("a", float(t), v.tolist()) for t, v in zip(target, wide)], "g string, y double, x array<double>")
    fits = regression.predict(many, regression.fit(many, "g", "y", "x", hidden=100, kind="ridge", reps=1), "g", "x").select("y", "yhat").toPandas()
    assert len(fits) == 150 and np.corrcoef(fits["y"], fits["yhat"])[0, 1] > 0.5


def test_perceptrons_of_a_table_are_those_of_its_rows_in_one_place(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (240, 2)).round(3)
    y = np.sin(2 * x[:, 0]) * x[:, 1]
    table = spark.createDataFrame([("ab"[i % 2], float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(240)] + [("a", None, 1.0, 2.0), ("c", 1.0, 1.0, None)], "grp string, u double, v double, y double").repartition(5)
    monkeypatch.setattr(perceptron, "SAVED", 4)
    models = perceptron.fit(table, "grp", "y", ["u", "v"], hidden=(3, 2), reps=2, steps=25).cache()
    scored = perceptron.predict(table, models, "grp", ["u", "v"]).cache()
    assert scored.count() == 242 and scored.where("yhat is null").count() == 2 and {r.g for r in models.collect()} == {"a", "b"}
    for r in models.collect():
        mine = np.arange(240) % 2 == "ab".index(r.g)
        ends = np.array(r.low), np.array(r.high)
        z = 2 * (np.c_[y, x][mine] - ends[0]) / (ends[1] - ends[0]) - 1
        for m in r.members:
            layers, settled = nets.mlp(z[:, 1:], z[:, 0], (3, 2), np.random.default_rng([42, zlib.crc32(r.g.encode()), m.rep]), steps=25)
            assert m.settled == settled and m.steps <= 25 and all(np.allclose(a, b, atol=1e-6) for a, b in zip(m.layers, layers, strict=True))
            guess = (nets.forward(z[:, 1:], layers, (), "logistic") + 1) / 2 * (ends[1][0] - ends[0][0]) + ends[0][0]
            got = scored.where(F.col("grp") == r.g).where("yhat is not null").select("u", "v", F.get("yhat_members", F.lit(m.rep)).alias("f")).toPandas()
            want = {tuple(k): f for k, f in zip(x[mine].tolist(), guess, strict=True)}
            assert np.allclose([want[u, v] for u, v in zip(got["u"], got["v"])], got["f"], atol=1e-6)
    on = perceptron.fit(table, "grp", "y", ["u", "v"], hidden=(3, 2), reps=2, steps=5, start=perceptron.saved(models))
    assert all(n.mse <= m.mse + 1e-9 for a, b in zip(models.orderBy("g").collect(), on.orderBy("g").collect()) for m, n in zip(a.members, b.members))
    done = perceptron.fit(table, "grp", "y", ["u"], hidden=(1,), reps=1, steps=40, threshold=1e6).collect()
    assert all(m.settled and m.steps == 1 for r in done for m in r.members)


def test_fits_that_do_not_settle_say_so(spark, monkeypatch):
    monkeypatch.setattr(regression, "PASSES", 2)
    table = spark.createDataFrame([("a", float(i % 7), float(i % 3 == 0)) for i in range(60)], "grp string, u double, y double")
    assert not regression.fit(table, "grp", "y", ["u"], hidden=3, kind="ls", reps=1, link="logistic").first().settled


def test_gaps_are_filled_as_asked_and_series_may_begin_by_themselves(spark):
    day = datetime.datetime
    table = spark.createDataFrame([("a", day(2020, 1, 5), 1.0), ("a", day(2020, 3, 1), 4.0), ("b", day(2020, 2, 2), 9.0), (None, day(2019, 2, 2), 9.0)], "id string, at timestamp_ntz, v double")
    rows = lambda **o: [(r.series_id, r.t, r.y) for r in series_from(table, "id", "at", "v", "month", **o).orderBy("series_id", "t").collect()]
    assert rows(fill="forward") == [("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 4.0), ("b", 1, None), ("b", 2, 9.0), ("b", 3, 9.0)]
    assert rows(start="own") == [("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 4.0), ("b", 1, 9.0), ("b", 2, 0.0)]
    with pytest.raises(Exception, match="no value of"):
        rows(fill="error")
    with pytest.raises(ValueError):
        rows(fill="x")


def test_calendars_of_every_grain(spark):
    day = datetime.datetime
    table = spark.createDataFrame([("a", day(2019, 12, 31, 23, 59), 1.0), ("a", day(2020, 2, 29, 0, 1), 2.0), ("b", day(2020, 1, 1), 3.0)], "id string, at timestamp_ntz, v double")
    sizes = {"year": 2, "quarter": 2, "month": 3, "week": 9, "day": 61, "hour": 1418}
    for grain, n in sizes.items():
        got = {(r.series_id, r.t): r for r in series_from(table, "id", "at", "v", grain).collect()}
        assert len(got) == 2 * n and sum(r.y for r in got.values()) == 6 and got["a", 1].y == 1 and got["a", n].y == 2, grain
        own = series_from(table, "id", "at", "v", grain, start="own", trim=1).where("series_id = 'b'").orderBy("t").collect()
        assert [r.t for r in own] == list(range(1, len(own) + 1)) and (not own or own[0].y == 3.0)
    assert series_from(table.where("at < '2020-01-01 00:05:00'"), "id", "at", "v", "minute").count() == 4
    with pytest.raises(ValueError):
        series_from(table, "id", "at", "v", "decade")


def test_series_may_have_periods_of_their_own_and_tried_sizes_are_kept(spark):
    y = list(np.random.default_rng(5).normal(size=60).cumsum())
    s, spec = frame(spark, a=y, b=y), fc.Spec(kind="mlp", periods=(4,), difforder=(1,), reps=2, hidden_type="valid", hidden_max=2, dummies=False)
    plans = fc.specify(s, spec, spark.createDataFrame([("b", [6.0])], "series_id string, periods array<double>")).cache()
    got = {r.series_id: r for r in plans.collect()}
    assert (got["a"].season, got["b"].season) == (4.0, 6.0) and max(got["b"].lags) <= 6
    assert [e.hidden for e in got["a"].hidden_errors] == [1, 2] and got["a"].hidden == [min(got["a"].hidden_errors, key=lambda e: e.mse).hidden]
    ahead = fc.predict(s, plans, fc.fit(s, plans, spec), spec).groupBy("series_id").agg(F.max("h").alias("h")).collect()
    assert {r.series_id: r.h for r in ahead} == {"a": 4, "b": 6}
    again = fc.reuse(s, plans, spec).collect()
    assert {r.series_id: [e.mse for e in r.hidden_errors] for r in again} == {k: [e.mse for e in r.hidden_errors] for k, r in got.items()}


def test_a_stream_takes_regressors_and_the_mean(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=60)
    y = 5 + np.r_[0, 2 * x[:-1]] + rng.normal(0, 0.1, 60)
    s = spark.createDataFrame([("a", t + 1, float(y[t]), [float(x[t])]) for t in range(60)], "series_id string, t int, y double, x array<double>")
    spec = fc.Spec(periods=(1,), lags=(1,), xreg_lags=((1, 2),), difforder=(0,), type="ls", hidden=4, direct=True, reps=3, barebone=True, select=False, comb="mean")
    plans = fc.specify(s, spec).cache()
    models = fc.fit(s, plans, spec).cache()
    want = [r.yhat for r in fc.ensemble(fc.predict(s, plans, models, spec, 2), ["series_id", "h"], how="mean").orderBy("h").collect()]
    s.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    out = scoring.score(stream, plans, models, spec, 2).writeStream.format("memory").queryName("with_x").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = [r.yhat for r in spark.table("with_x").orderBy("h").collect()]
    assert want[0] is not None and want[1] is None and got[1] is None and np.isclose(got[0], want[0])


def test_reconciled_levels_add_up(spark):
    base = [("a", k, h + 1, float(10 * k + h)) for k in (4, 2, 1) for h in range(8 // k)] + [("b", 4, 1, 1.0)]
    got = {(r.series_id, r.k, r.h): r.yhat for r in hierarchy.reconcile(spark.createDataFrame(base, "series_id string, k int, h int, yhat double"), 4).collect()}
    assert len(got) == 21 and all(got[k] is None for k in got if k[0] == "b")
    for season in (0, 1):
        months = [got["a", 1, 4 * season + i] for i in (1, 2, 3, 4)]
        assert math.isclose(sum(months), got["a", 4, season + 1]) and math.isclose(sum(months[:2]), got["a", 2, 2 * season + 1])
    s = frame(spark, a=range(1, 11))
    assert sorted((r.k, r.t, r.y) for r in hierarchy.levels(s, 4).where("k > 1").collect()) == [(2, 1, 7), (2, 2, 11), (2, 3, 15), (2, 4, 19), (4, 1, 18), (4, 2, 34)]


def test_reconciliation_equals_the_dense_projection_and_takes_long_seasons(spark):
    rng = np.random.default_rng(3)
    for m in (1, 6, 12, 30):
        ks = hierarchy.divisors(m)
        base = [("a", k, j + 1, float(rng.normal())) for k in ks for j in range(m // k)]
        value = {(k, j - 1): v for _, k, j, v in base}
        want = {}
        for out_k, out_j, k, j, w in native.weights(m):
            want[out_k, out_j + 1] = want.get((out_k, out_j + 1), 0.0) + w * value[k, j]
        got = {(r.k, r.h): r.yhat for r in hierarchy.reconcile(spark.createDataFrame(base, "series_id string, k int, h int, yhat double"), m).collect()}
        assert set(got) == set(want) and np.allclose([got[n] for n in want], list(want.values()), rtol=1e-9, atol=1e-11)
    m = 8760  # hours of a year: a dense matrix would have 13,000,000 places a level
    y = 10 + rng.normal(size=m)
    base = [("a", k, j + 1, float(v) * (1.1 if k == 24 else 1.0)) for k in hierarchy.divisors(m) for j, v in enumerate(y.reshape(-1, k).sum(1))]
    got = {}
    for r in hierarchy.reconcile(spark.createDataFrame(base, "series_id string, k int, h int, yhat double"), m).collect():
        got.setdefault(r.k, {})[r.h] = r.yhat
    hours = np.array([got[1][h] for h in range(1, m + 1)])
    assert all(np.allclose([got[k][h] for h in range(1, m // k + 1)], hours.reshape(-1, k).sum(1)) for k in got) and hours.sum() > 1.001 * y.sum()


def test_a_stream_is_forecast_as_the_table_is(spark, tmp_path):
    y = [10 + 0.5 * t + 4 * math.sin(2 * math.pi * t / 6) for t in range(1, 61)]
    s, spec = frame(spark, a=y), fc.Spec(type="ls", hidden=6, reps=3, periods=(6,), lags=(1, 2, 6), select=False, difforder=(1,), dummies=False)
    plans = fc.specify(s, spec).cache()
    models = fc.fit(s, plans, spec).cache()
    want = [r.yhat for r in fc.ensemble(fc.predict(s, plans, models, spec, 3), ["series_id", "h"]).orderBy("h").collect()]
    for i, part in enumerate(("t <= 40", "t > 35 and t <= 60")):
        s.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = scoring.score(stream, plans, models, spec, 3).writeStream.format("memory").queryName("scored").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = [r.yhat for r in spark.table("scored").where("t = 60").orderBy("h").collect()]
    assert np.allclose(got, want)


def test_results_do_not_depend_on_partitions(spark):
    y = list(np.random.default_rng(5).normal(size=60).cumsum())
    spec = fc.Spec(kind="mlp", reps=2, periods=(4,))
    runs = [frame(spark, a=y), frame(spark, a=y).repartition(7).orderBy(F.col("t").desc())]
    one, two = (fc.fit(s, fc.specify(s, spec), spec).orderBy("rep").collect() for s in runs)
    assert one == two and one[0].layers != one[1].layers


def test_wrong_options_are_refused():
    for wrong in ({"kind": "x"}, {"type": "x"}, {"lags": (0, 1)}, {"lags": (1, 2), "keep": (3,)}, {"comb": "x"}, {"det_type": "x"}, {"folds": "x"}, {"barebone": True, "hidden": (3, 2)}, {"det_type": "bin", "periods": (30.5,)}):
        with pytest.raises(ValueError):
            fc.Spec(**wrong)


def test_reused_leaves_out_the_last_year_of_each_series(spark, monkeypatch):
    rows = [(s, t, None, 100 + 9.0 * (t % 12) + t % 5) for s, n in (("a", 79), ("b", 100)) for t in range(1, n + 1)]
    series = spark.createDataFrame(rows, "series_id string, t int, ts timestamp_ntz, y double")
    seen, specify = [], ensembles.fc.specify
    monkeypatch.setattr(ensembles, "orders_monthly", lambda *_: series)
    monkeypatch.setattr(ensembles.fc, "specify", lambda s, spec: seen.append(s) or specify(s, spec))
    ensembles.reused(spark, "")
    assert {r[0]: r[1] for r in seen[0].groupBy("series_id").agg({"t": "max"}).collect()} == {"a": 67, "b": 88}
