"""Fitting and forecasting of many series: a plan for each series, its ensemble's networks, their forecasts and one-step values.

A series is packed into one row (operators/design.py), in which differences, scaling, inputs, tests of season and trend, forecasts
and fitted values are expressions. Its design table goes on as rows, one step each: from these, sums of products by unit decide
which inputs stay and what the output weights are, so that Python holds a batch of steps and those sums. A unit is a series
and some of its members; there are as many as give every core something to do, one a series where there are many. Only
perceptrons, which are trained on all steps again and again, gather the steps of a unit.

A series is rows (series_id, t, y) with t dense from 1, and x array<double> where there are outside regressors; rows past the
last y give the regressors' future. A plan, a model and a forecast are DataFrames: write them as Parquet to keep them. A series
that can't be fitted gets a status other than ok and null forecasts; it doesn't stop the others. Null and repeated steps inside
a series count as gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidecast.functions import arrays as A
from tidecast.functions import nets, stats, unitroots
from tidecast.functions.transforms import combine
from tidecast.operators.design import PLAN_NAMES, depth, design, one_step, packed, path, planned, shift, spread
from tidecast.sources.written import materialise

MODEL = "series_id string, rep int, activation string, layers array<array<array<double>>>, direct array<double>, settled boolean"
SIZES = "series_id string, hidden int, fold int, mse double"


@dataclass(frozen=True)
class Spec:
    """What to build. difforder None: found by tests; () or (0,): none. lags (0,): no lags of the series itself.

    kind: elm or mlp. periods: the seasonal periods in steps, several for several seasonalities; specify may be given others for
    some series. hidden: neurons, or a tuple of layers; 0 in an elm with direct: none; None: 5 (hidden_type set), by validation (valid), five folds (cv) or random networks (elm). folds: steps fall into them at
    random, or in stretches of time (valid then holds out the last fifth). type: the elm's output
    weights. penalty: of lasso and ridge, see stats.cross_validated. barebone: the elm's uniform softsign layer instead of normal logistic ones. strict: a seasonal difference is taken only together with the one for trend; also,
    rejected lags stay where regressors or dummies are left.
    """

    kind: str = "elm"
    periods: tuple[float, ...] = (12,)
    lags: tuple[int, ...] | None = None
    keep: tuple[int, ...] = ()
    xreg_lags: tuple[tuple[int, ...], ...] | None = None
    xreg_keep: tuple[tuple[int, ...], ...] = ()
    difforder: tuple[int, ...] | None = None
    select: bool = True
    dummies: bool = True
    det_type: str = "auto"
    hidden: int | tuple[int, ...] | None = None
    hidden_type: str = "set"
    hidden_max: int | None = None
    folds: str = "random"
    type: str = "lasso"
    penalty: str = "1se"
    direct: bool = False
    barebone: bool = False
    ortho: bool = False
    comb: str = "median"
    reps: int = 20
    strict: bool = True
    phase: int = 0
    seed: int = 42

    def __post_init__(self):
        enums = {"kind": ("elm", "mlp"), "type": ("lasso", "ridge", "step", "ls", "lm"), "det_type": ("auto", "bin", "trg"), "hidden_type": ("set", "valid", "cv", "elm"), "folds": ("random", "time"), "comb": ("median", "mean", "mode"), "penalty": ("1se", "min")}
        for name, allowed in enums.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")
        if self.lags is not None and 0 in self.lags and len(self.lags) > 1:
            raise ValueError("a series can't be its own input: lag 0 stands alone, for no lags")
        if set(self.keep) - set(self.candidates):
            raise ValueError("only lags can be kept")
        if self.barebone and len(self.layers or ()) > 1:
            raise ValueError("a barebone elm has one hidden layer")
        if self.det_type == "bin" and any(m != int(m) for m in self.periods):
            raise ValueError("a period that isn't whole takes trigonometric dummies")

    @property
    def m(self) -> int:
        return int(max(self.periods))

    @property
    def layers(self) -> tuple[int, ...] | None:
        return (self.hidden,) if isinstance(self.hidden, int) else self.hidden

    @property
    def candidates(self) -> tuple[int, ...]:
        if self.lags is not None:
            return () if self.lags == (0,) else self.lags
        return tuple(range(1, (self.m if self.m > 3 else 4) + 1))


def rng_of(spec: Spec, series: str, *more: int) -> np.random.Generator:
    return np.random.default_rng([spec.seed, zlib.crc32(str(series).encode()), *more])


def ints(values) -> Column:
    return F.array(*(F.lit(int(v)) for v in values)).cast("array<int>")


class Unit:
    """What is made of the steps of a unit as they come: add(x, y) takes some, end() gives rows."""

    def __init__(self, row):
        self.row, self.seen = row, 0


def stream(rows: DataFrame, keys: list[str], make: Callable, schema: str) -> DataFrame:
    """Rows of a design table, those of a unit one after the other, through make(first row): a Unit. Memory: one batch and one unit."""
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, unit = None, None
        for batch in batches:
            out = []
            for at, part in batch.groupby(keys, sort=False, dropna=False):
                if at != now:
                    out += unit.end() if unit else []
                    now, unit = at, make(next(part.itertuples(index=False)))
                unit.add(np.stack(part["x"].to_list()), part["target"].to_numpy(float))
                unit.seen += len(part)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if unit:
            yield pd.DataFrame(unit.end(), columns=columns)

    return rows.mapInPandas(run, schema)


def shares(plans: DataFrame, most: int) -> int:
    """Into how many units a series' work is cut, so that there are a few for every core; at most `most`."""
    series = plans.where("status = 'ok'").count()
    return max(1, min(most, -(-2 * plans.sparkSession.sparkContext.defaultParallelism // max(series, 1))))


def parted(series: DataFrame, plans: DataFrame, spec: Spec, cut: int, *keep: str) -> DataFrame:
    """Design rows (series_id, part, keep..., at, target, x) of the series whose plan is ok, for each of cut parts."""
    units = planned(series, plans.where("status = 'ok'")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(cut - 1))))
    return design(spread(units, "series_id", "part"), spec.phase, "series_id", "part", *keep)


class Moments(Unit):
    """Sums of products of (1, inputs, target), of all steps or by fold."""

    def __init__(self, row, fold: np.ndarray | None):
        super().__init__(row)
        self.fold, self.sums = fold, {}

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        fold = np.zeros(len(y), int) if self.fold is None else self.fold[self.seen : self.seen + len(y)]
        for f in np.unique(fold):
            self.sums[f] = self.sums.get(f, 0.0) + stats.moments(x[fold == f], y[fold == f])

    def end(self) -> list[tuple]:
        return [(self.row.series_id, [m.ravel().tolist() for _, m in sorted(self.sums.items())])]


def selection(series: DataFrame, plans: DataFrame, spec: Spec) -> DataFrame:
    """(series_id, held, by_lasso): the blocks of inputs that backward selection leaves, lasso where there are too few steps.

    Blocks are counted from 0: lags, then each regressor's lags, then each period's dummies.
    """
    wide = lambda row: row.rows > row.inputs + 2
    make = lambda row: Moments(row, None if wide(row) else rng_of(spec, row.series_id).permutation(row.rows) % min(5, row.rows))
    sums = stream(parted(series, plans, spec, 1, "inputs", "rows"), ["series_id", "part"], make, "series_id string, sums array<array<double>>")
    flat = F.flatten("xreg_lags")
    keeps = F.array(*(ints(ks) for ks in spec.xreg_keep or ((),)))
    of_x = F.transform("xreg_lags", lambda ks, i: F.transform(ks, lambda k: F.coalesce(F.array_contains(F.get(keeps, i), k), F.lit(False))))
    marks = F.concat(F.transform("lags", lambda k: F.array_contains(ints(spec.keep), k)), F.flatten(of_x), F.transform("periods", lambda _: F.lit(False)))
    widths = F.concat(F.transform("lags", lambda _: F.lit(1)), F.transform(flat, lambda _: F.lit(1)), F.transform("periods", lambda m: dummies_of(m)))
    rows = sums.join(plans.select("series_id", "inputs", "rows", marks.alias("marks"), widths.alias("widths")), "series_id")
    rule = spec.penalty

    @pandas_udf("array<int>")
    def choose(sums: pd.Series, widths: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for folds, size, kept in zip(sums, widths, marks, strict=True):
            folds = [np.asarray(m).reshape(int(len(m) ** 0.5), -1) for m in folds]
            ends = np.cumsum(size)
            columns = [list(range(e - k, e)) for e, k in zip(ends, size, strict=True)]
            if len(folds) == 1:
                out.append(stats.swept(folds[0], columns, {j for j, k in enumerate(kept) if k}))
            else:
                w = stats.cross_validated(folds, stats.lasso_path, rule=rule)
                out.append([j for j, own in enumerate(columns) if kept[j] or (w[1 + np.array(own)] != 0).any()])
        return pd.Series(out)

    return rows.select("series_id", choose("sums", "widths", "marks").alias("held"), (F.size("sums") > 1).alias("by_lasso"))


def dummies_of(m: Column) -> Column:
    """Columns of a period's dummies."""
    return F.when(F.col("det_type") == "bin", m.cast("int") - 1).when(m == 2, 1).otherwise(2)


def selected(plans: DataFrame, held: DataFrame, spec: Spec) -> DataFrame:
    """Plans with the inputs that selection leaves. Waves always stay, and so do rejected lags where strict and nothing else is left."""
    rows = plans.join(held, "series_id", "left")
    at = lambda values, first: F.filter(values, lambda v, j: F.array_contains("held", (j + first).cast("int")))
    lags, n = at(F.col("lags"), F.lit(0)), F.size("lags")
    before = lambda i: F.size(F.flatten(F.slice("xreg_lags", F.lit(1), i)))
    xreg = F.transform("xreg_lags", lambda ks, i: F.filter(ks, lambda k, j: F.array_contains("held", (j + n + before(i)).cast("int"))))
    periods = F.when(F.col("det_type") == "trg", F.col("periods")).otherwise(at(F.col("periods"), n + F.size(F.flatten("xreg_lags"))))
    rows = rows.select("*", lags.alias("l"), xreg.alias("x"), periods.alias("p"))
    rest = (F.size("p") > 0) | (F.size(F.flatten("x")) > 0)
    back = F.lit(True) if spec.strict else ~rest
    nothing = (F.size(F.flatten("x")) == 0) & ((F.size("periods") == 0) | ((F.size("lags") == 0) & (F.size("p") == 0)))
    lags = F.when(F.size("l") > 0, F.col("l")).when(nothing, ints((1,))).when(back, F.col("lags")).otherwise(F.col("l"))
    warning = F.when((F.size("l") == 0) & nothing, "no inputs left: the last value is used").when(F.col("by_lasso"), "selected by lasso").otherwise(F.col("warning"))
    new = {"lags": lags, "xreg_lags": F.col("x"), "periods": F.col("p"), "warning": warning}
    return rows.select(*(F.when(F.col("held").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in PLAN_NAMES))


def counted(plans: DataFrame) -> DataFrame:
    """Plans with the number of their inputs and of the rows that have all lags (rows holds the steps of the differences before)."""
    many = F.size("lags") + F.size(F.flatten("xreg_lags")) + F.aggregate(F.transform("periods", dummies_of), F.lit(0), lambda s, k: s + k)
    return plans.withColumns({"inputs": F.when(F.col("status") == "ok", many).otherwise(0), "rows": F.when(F.col("status") == "ok", F.col("steps") - depth()).otherwise(0)})


def specify(series: DataFrame, spec: Spec, periods: DataFrame | None = None) -> DataFrame:
    """A row of PLAN for each series: differences, inputs, dummies, scaling and hidden layers.

    periods: (series_id, periods array<double>) for series whose seasons are not those of spec. Where sizes of the hidden layer
    are tried, hidden_errors keeps the error of each.
    """
    units = packed(series)
    every = F.array(*(F.lit(float(m)) for m in spec.periods))
    if periods is not None:
        units = units.join(periods.select(F.col("series_id").cast("string").alias("series_id"), F.col("periods").cast("array<double>").alias("own")), "series_id", "left")
        every = F.when(F.size("own") > 0, F.col("own")).otherwise(every)
    units = spread(units.withColumns({"every": every, "m": F.array_max(every).cast("int")}), "series_id")

    candidates = ints(spec.candidates) if spec.lags is not None else A.upto(1, F.when(F.col("m") > 3, F.col("m")).otherwise(4))
    given = F.array(*(ints(ks) for ks in spec.xreg_lags)).cast("array<array<int>>") if spec.xreg_lags is not None else F.transform(A.upto(1, F.col("width")), lambda _: candidates)
    bad = F.when(F.col("width") < 0, "regressors and their lags don't match")
    if spec.xreg_lags is not None:
        bad = bad.when(F.col("width") != len(spec.xreg_lags), "regressors and their lags don't match")
    bad = bad.when((F.col("width") > 0) & (F.size("x") < F.size("y")), "regressors are shorter than the series").when((F.size("y") == 0) | ~F.col("sound"), "too short or with gaps")
    flat = bad.isNull() & (F.array_min("y") == F.array_max("y"))
    open_ = spec.difforder is None

    def tests(cma: Column) -> Column:
        season = A.seasonal(F.col("y"), cma, F.col("m"))
        if not open_:
            return F.struct(season.alias("season"))
        ratio = (F.array_min("y") > 0) & ((F.size("y") / F.col("m") < 3) | A.multiplicative(F.col("y"), cma, F.col("m")))
        free = lambda s: F.when(s, A.let(ratio, lambda r: F.zip_with("y", cma, lambda v, c: F.when(r, v / F.nullif(c, F.lit(0.0))).otherwise(v - c))))
        return A.let(season, lambda s: F.struct(s.alias("season"), A.trending(cma).alias("trend"), free(s).alias("free")))

    found = F.when(bad.isNull() & ~flat, A.let(A.centred_average(F.col("y"), F.col("m")), tests)) if spec.dummies or open_ else F.struct(F.lit(False).alias("season"))
    units = units.withColumns({"lags": candidates, "xreg_lags": given, "bad": bad, "flat": flat, "tests": found})
    live = F.col("bad").isNull() & ~F.col("flat")
    if open_:
        units = materialise(units, "tests")  # what follows asks for each test more than once
        up = F.coalesce("tests.trend", F.lit(False))
        units = units.withColumn("root", unitroots.seasonal_roots("tests.free", "m"))
        order = F.concat(F.when(up, ints((1,))).otherwise(ints(())), F.when(F.col("root") & (up if spec.strict else F.lit(True)), F.array("m")).otherwise(ints(())))
    else:
        order = ints([] if 0 in spec.difforder else spec.difforder)
    units = units.withColumn("difforder", F.when(live, order).otherwise(ints(())))
    steps = F.size("y") - shift()
    short = live & (steps <= depth() + 2)
    several = F.size("every") > 1
    dummied = live & ~short & F.lit(spec.dummies) & (F.col("m") > 1) & (several | ~F.array_contains("difforder", F.col("m"))) & F.coalesce("tests.season", F.lit(False))
    whole = ~several & (F.get("every", F.lit(0)) == F.col("m")) & (F.col("m") <= 12)
    kind = F.lit(spec.det_type) if spec.det_type != "auto" else F.when(whole, "bin").otherwise("trg")
    d = F.when(live & ~short, A.ladder(F.col("y"), F.col("difforder"))).when(F.col("flat"), F.slice("y", 1, 1))
    units = units.withColumns({"steps": steps, "short": short, "d": d, "periods": F.when(dummied, F.col("every")).otherwise(A.none())})
    low, high = F.array_min("d"), F.array_max("d")
    empty = (F.size("lags") == 0) & (F.size(F.flatten("xreg_lags")) == 0) & (F.size("periods") == 0)
    status = F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("short"), "too short or with gaps").when(F.col("flat") | (low == high), "constant").when(empty, "no inputs").otherwise("ok")
    ends = lambda pick: F.when((F.col("status") == "ok") & (F.col("width") > 0), A.let(F.slice("x", shift() + 1, F.size("x") - shift()), lambda x: F.transform(A.upto(0, F.col("width") - 1), lambda j: pick(F.transform(x, lambda r: F.get(r, j)))))).otherwise(A.none())
    constant = F.col("status") == "constant"
    plans = units.withColumn("status", status).select(
        "series_id", "status", F.lit("").alias("warning"), F.array_max("every").alias("season"), "difforder",
        F.when(constant, ints(())).otherwise(F.col("lags")).alias("lags"), F.when(constant, F.array().cast("array<array<int>>")).otherwise(F.col("xreg_lags")).alias("xreg_lags"),
        F.when(constant, A.none()).otherwise(F.col("periods")).alias("periods"), F.when(F.size("periods") > 0, kind).alias("det_type"), low.alias("low"), high.alias("high"),
        ends(F.array_min).alias("x_low"), ends(F.array_max).alias("x_high"), F.lit(None).cast("array<int>").alias("hidden"), F.lit(None).cast("array<struct<hidden:int,mse:double>>").alias("hidden_errors"), "steps",
    )
    plans = counted(plans)
    if spec.select:
        plans = materialise(plans, "plans")
        steps = plans.select("series_id", "steps")
        plans = counted(selected(plans, selection(series, plans, spec), spec).join(steps, "series_id"))
    if spec.layers is not None:
        plans = plans.withColumn("hidden", F.when(F.col("status") == "ok", ints(spec.layers)))
    elif spec.kind == "mlp" and spec.hidden_type == "set":
        plans = plans.withColumn("hidden", F.when(F.col("status") == "ok", ints((5,))))
    plans = plans.select(*PLAN_NAMES)
    if spec.kind == "mlp" and spec.layers is None and spec.hidden_type != "set":
        plans = materialise(plans, "plans")
        best = significant(series, plans, spec) if spec.hidden_type == "elm" else least_error(series, plans, spec)
        plans = plans.drop("hidden", "hidden_errors").join(best, "series_id", "left").select(*PLAN_NAMES)
    return plans


class Significant(Unit):
    """The rounded median, over random networks, of the neurons that are significant after backward selection; at least 1."""

    def __init__(self, row, rng: np.random.Generator, nets_tried: int = 20):
        super().__init__(row)
        size = max(1, min(row.inputs + 2, row.rows - 2))
        self.tried = [nets.random_layers(row.inputs, (size,), False, False, rng) for _ in range(nets_tried)]
        self.sums = [0.0] * nets_tried

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        for k, layers in enumerate(self.tried):
            self.sums[k] = self.sums[k] + stats.moments(nets.hidden_output(x, layers, "logistic"), y)

    def end(self) -> list[tuple]:
        counts = [int((stats.least_squares(m, True)[1] < 0.05).sum()) for m in self.sums]
        return [(self.row.series_id, [max(1, round(float(np.median(counts))))])]


def significant(series: DataFrame, plans: DataFrame, spec: Spec) -> DataFrame:
    rows = parted(series, plans, spec, 1, "inputs", "rows")
    found = stream(rows, ["series_id", "part"], lambda row: Significant(row, rng_of(spec, row.series_id, 1)), "series_id string, hidden array<int>")
    return found.withColumn("hidden_errors", F.lit(None).cast("array<struct<hidden:int,mse:double>>"))


def least_error(series: DataFrame, plans: DataFrame, spec: Spec) -> DataFrame:
    errors = hidden_errors(series, plans, spec).groupBy("series_id", "hidden").agg(F.avg("mse").alias("mse"))
    return errors.groupBy("series_id").agg(F.array(F.min_by("hidden", F.struct("mse", "hidden"))).alias("hidden"), F.sort_array(F.collect_list(F.struct("hidden", "mse"))).alias("hidden_errors"))


class Gathered(Unit):
    """All steps of a unit, for what is trained on them again and again."""

    def __init__(self, row, run: Callable):
        super().__init__(row)
        self.run, self.x, self.y = run, [], []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x.append(x)
        self.y.append(y)

    def end(self) -> list[tuple]:
        return self.run(self.row, np.concatenate(self.x), np.concatenate(self.y))


def hidden_errors(series: DataFrame, plans: DataFrame, spec: Spec) -> DataFrame:
    """(series_id, hidden, fold, mse) of ensembles trained without each fold."""
    folds = 5 if spec.hidden_type == "cv" else 1
    tried = min(20, max(2, spec.reps))
    cut = shares(plans, 1000)

    def run(row, matrix: np.ndarray, target: np.ndarray) -> list[tuple]:
        most, out, n = spec.hidden_max or max(2, min(row.inputs + 2, row.rows - 2)), [], len(target)
        order = np.arange(n)[::-1] if spec.folds == "time" else rng_of(spec, row.series_id, 2).permutation(n)
        for size, fold in [(size, fold) for size in range(1, most + 1) for fold in range(folds)][row.part :: cut]:
            left = order * 5 // n == fold if folds == 5 else order < round(0.2 * n)
            rng = rng_of(spec, row.series_id, 3, size, fold)
            guesses = [nets.forward(matrix[left], nets.mlp(matrix[~left], target[~left], (size,), rng)[0], (), "logistic") for _ in range(tried)]
            guess = np.array([combined(v, spec.comb) for v in np.transpose(guesses)])
            out.append((row.series_id, size, fold, float(((guess - target[left]) ** 2).mean())))
        return out

    return stream(parted(series, plans, spec, cut, "inputs", "rows"), ["series_id", "part"], lambda row: Gathered(row, run), SIZES)


def combined(v: np.ndarray, how: str) -> float:
    return float({"median": np.median, "mean": np.mean, "mode": stats.density_mode}[how](v))


class Members(Unit):
    """Extreme learning machines of a unit, from sums of products of their neurons."""

    def __init__(self, row, reps: range, spec: Spec):
        super().__init__(row)
        hidden = tuple(int(k) for k in row.hidden) if row.hidden is not None and len(row.hidden) else None
        self.reps = [(rep, nets.Elm(row.inputs, row.rows, hidden, spec.type, spec.direct, rng_of(spec, row.series_id, 9, rep), spec.barebone, spec.ortho, spec.penalty)) for rep in reps]
        self.name = "softsign" if spec.barebone else "logistic"

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        for _, elm in self.reps:
            elm.add(x, y)

    def end(self) -> list[tuple]:
        solved = [(rep, *elm.solve()) for rep, elm in self.reps]
        return [(self.row.series_id, rep, self.name, [w.tolist() for w in layers], direct.tolist(), True) for rep, layers, direct in solved]


def fit(series: DataFrame, plans: DataFrame, spec: Spec) -> DataFrame:
    """A row of MODEL for each member of each series whose plan is ok; settled: whether its training came to an end by itself."""
    cut = shares(plans, spec.reps)

    def train(row, matrix: np.ndarray, target: np.ndarray) -> list[tuple]:
        hidden, out = tuple(int(k) for k in row.hidden) if row.hidden is not None and len(row.hidden) else (5,), []
        for rep in range(row.part, spec.reps, cut):
            layers, settled = nets.mlp(matrix, target, hidden, rng_of(spec, row.series_id, 9, rep))
            out.append((row.series_id, rep, "logistic", [w.tolist() for w in layers], [], settled))
        return out

    make = (lambda row: Gathered(row, train)) if spec.kind == "mlp" else (lambda row: Members(row, range(row.part, spec.reps, cut), spec))
    return stream(parted(series, plans, spec, cut, "inputs", "rows", "hidden"), ["series_id", "part"], make, MODEL)


def reuse(series: DataFrame, plans: DataFrame, spec: Spec, frozen: bool = False) -> DataFrame:
    """Saved plans for new data: inputs stay, the scaling follows the new data unless frozen. Fit again with these to retrain.

    A series without plan, with other regressors or without the season its dummies need gets a status that says so. Plans of
    series that the new data lack stay as they are.
    """
    units = spread(planned(series, plans, "left"), "series_id")
    m, ok = F.col("season").cast("int"), F.col("status") == "ok"
    season = A.let(A.centred_average(F.col("y"), m), lambda c: A.seasonal(F.col("y"), c, m))
    status = (
        F.when(F.col("status").isNull(), "no saved plan").when(ok & (F.col("width") != F.size("xreg_lags")), "regressors and their lags don't match")
        .when((F.size("y") - shift() <= depth()) | ~F.col("sound"), "too short or with gaps").when((F.size("periods") > 0) & ~season, "the plan's season isn't in the data").otherwise(F.col("status"))
    )
    units = units.withColumn("now", status).withColumn("fresh", (F.col("now") == "ok") & F.lit(not frozen)).withColumn("d", F.when(F.col("fresh"), A.ladder(F.col("y"), F.col("difforder"))))
    ends = lambda pick: A.let(F.slice("x", shift() + 1, F.size("x") - shift()), lambda x: F.transform(A.upto(0, F.col("width") - 1), lambda j: pick(F.transform(x, lambda r: F.get(r, j)))))
    new = {"status": F.col("now")} | {c: F.when(F.col("fresh"), pick("d")).otherwise(F.col(c)) for c, pick in (("low", F.array_min), ("high", F.array_max))}
    new |= {c: F.when(F.col("fresh") & (F.col("width") > 0), ends(pick)).otherwise(F.col(c)) for c, pick in (("x_low", F.array_min), ("x_high", F.array_max))}
    kept = units.select(*(new[c].alias(c) if c in new else c for c in PLAN_NAMES))
    return kept.unionByName(plans.join(series.select(F.col("series_id").cast("string").alias("series_id")).distinct(), "series_id", "left_anti").select(*PLAN_NAMES))


def with_models(series: DataFrame, plans: DataFrame, models: DataFrame) -> DataFrame:
    """Packed series beside their plans and packed members, in order."""
    members = models.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("rep", "activation", "layers", "direct"))).alias("members"))
    return spread(planned(series, plans).join(members, "series_id", "left"), "series_id")


def predict(series: DataFrame, plans: DataFrame, models: DataFrame, spec: Spec, h: int | None = None) -> DataFrame:
    """(series_id, rep, h, yhat): forecasts of each member for h steps (a season), each on its own predictions. A series that has no networks: rep 0.

    Regressors must reach h steps past the last y, or the forecasts are null from the first missing step.
    """
    ahead = F.lit(h) if h else F.coalesce(F.col("season").cast("int"), F.lit(spec.m))
    rows = with_models(series, plans, models).select("series_id", F.explode(path(F.col("members"), ahead, F.lit(spec.phase))).alias("m"))
    return rows.select("series_id", F.col("m.rep").alias("rep"), F.posexplode("m.yhat").alias("h", "yhat")).withColumn("h", F.col("h") + 1)


def fitted(series: DataFrame, plans: DataFrame, models: DataFrame, spec: Spec) -> DataFrame:
    """(series_id, rep, t, y, fitted): one-step values of each member."""
    return one_step(with_models(series, plans.where("status = 'ok'"), models).where("members is not null"), spec.phase)


def season_tests(series: DataFrame, m: int) -> DataFrame:
    """(series_id, seasons, stat, p_value, seasonal): Friedman's test as plans use it; stat is null where there is none."""
    y, length = F.col("y"), F.lit(m)
    test = F.when(F.col("sound") & (F.size("y") > 0), A.let(A.centred_average(y, length), lambda c: A.friedman(y, c, length)))
    rows = spread(packed(series), "series_id").withColumn("f", test).select("series_id", F.coalesce("f.seasons", F.lit(0)).alias("seasons"), F.col("f.stat").alias("stat"))
    return rows.withColumn("p_value", A.chi2_tail(F.col("stat"), F.lit(m - 1))).withColumn("seasonal", F.coalesce(F.col("p_value") <= 0.05, F.lit(False)))


def mode_of(v: pd.Series) -> float:
    return stats.density_mode(v.to_numpy()) if len(v) else None


def ensemble(members: DataFrame, by: list[str], value: str = "yhat", how: str = "median") -> DataFrame:
    """Mean, median or density mode of the members. A null member makes mean and median null.

    The mode leaves out every member that has a null in any group of its series; a group without members is null.
    """
    if how != "mode":
        return combine(members, by, value, how)
    if {"series_id", "rep"} <= set(members.columns):
        broken = members.where(F.col(value).isNull()).select("series_id", "rep").distinct()
        whole = members.join(broken, ["series_id", "rep"], "left_anti")
    else:
        whole = members.where(F.col(value).isNotNull())
    modes = whole.groupBy(*by).agg(pandas_udf(mode_of, "double")(value).alias(value))
    return members.select(*by).distinct().join(modes, by, "left")


def residuals(series: DataFrame, members: DataFrame, spec: Spec) -> DataFrame:
    """(series_id, t, y, fitted, residual) for every step of the series; null where no network reaches."""
    one = ensemble(members, ["series_id", "t"], "fitted", spec.comb)
    return series.where("y is not null").select(F.col("series_id").cast("string").alias("series_id"), "t", "y").join(one, ["series_id", "t"], "left").withColumn("residual", F.col("y") - F.col("fitted"))


def thief(series: DataFrame, spec: Spec, h: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fits and forecasts in one call, as a level of a temporal hierarchy needs: (forecast, padded fitted values)."""
    plans = materialise(specify(series, spec), "plans")
    models = materialise(fit(series, plans, spec), "models")
    members = predict(series, plans, models, spec, h)
    return ensemble(members, ["series_id", "h"], how=spec.comb), residuals(series, fitted(series, plans, models, spec), spec)
