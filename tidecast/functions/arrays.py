"""Series as arrays in a row, worked on by expressions: differences, scaling, averages, tests of season and trend, networks.

What is used more than once is bound by let(), since Catalyst copies an expression to every place that names it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (node, weight) of Gauss and Legendre's rule on (0, 1).
RULE = [((n + 1) / 2, w / 2) for n, w in zip(*(v.tolist() for v in np.polynomial.legendre.leggauss(64)), strict=True)]
ROUNDS, CELLS, SHARES = 3, 13, 9


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """build(value), in which value is worked out once."""
    return F.element_at(F.transform(F.array(value), build), 1)


def none() -> Column:
    return F.array().cast("array<double>")


def upto(first, last) -> Column:
    """first, first + 1, ..., last; empty where last is less."""
    first, last = (F.lit(v) if isinstance(v, int) else v for v in (first, last))
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def ladder(y: Column, order: Column) -> Column:
    """y after its successive differences at the lags of order; each is shorter than the one before."""
    rest = lambda a, k: F.greatest(F.size(a) - k, F.lit(0))
    return F.aggregate(order, y, lambda a, k: F.zip_with(F.slice(a, k + 1, rest(a, k)), F.slice(a, F.lit(1), rest(a, k)), lambda p, q: p - q))


def scaled(v: Column, low: Column, high: Column) -> Column:
    return 1.6 * (v - low) / F.when(high > low, high - low).otherwise(1.0) - 0.8


def unscaled(v: Column, low: Column, high: Column) -> Column:
    return (v + 0.8) / 1.6 * (high - low) + low


def centred_average(y: Column, m: Column) -> Column:
    """Centred moving average of m steps (2 x m where m is even); both ends hold the nearest whole one; short series their mean."""
    n, half = F.size(y), F.floor(m / 2).cast("int")
    even = (m % 2 == 0).cast("int")
    at = lambda i: let(F.slice(y, i - half + 1, 2 * half + 1), lambda w: (total(w) - even * 0.5 * (F.element_at(w, 1) + F.element_at(w, -1))) / m)
    inner = F.transform(upto(half, n - half - 1), at)
    held = let(inner, lambda a: F.transform(upto(0, n - 1), lambda i: F.get(a, F.least(F.greatest(i, half), n - half - 1) - half)))
    return F.when(m <= 1, y).when(n < m + even, F.transform(y, lambda _: mean(y))).otherwise(held)


def ranks(a: Column) -> Column:
    """Ranks from 1; equal values share the mean of theirs."""
    return F.transform(a, lambda v: F.aggregate(a, F.lit(0.5), lambda s, w: s + F.when(w < v, 1.0).when(w == v, 0.5).otherwise(0.0)))


def friedman(y: Column, cma: Column, m: Column) -> Column:
    """struct(seasons, stat) of Friedman's test over the whole seasons of y, by its average or less it; stat is null where there is none."""
    whole = F.when(m > 1, F.floor(F.size(y) / m).cast("int")).otherwise(0)
    positive = F.array_min(y) > 0
    free = F.zip_with(y, cma, lambda v, c: F.when(positive, v / F.nullif(c, F.lit(0.0))).otherwise(v - c))
    # by season of ranks, centred
    by_block = let(free, lambda v: F.transform(upto(0, whole - 1), lambda b: F.transform(ranks(F.slice(v, b * m + 1, m)), lambda r: r - (m + 1) / 2)))
    zeros = F.transform(upto(1, m), lambda _: F.lit(0.0))
    sums = lambda blocks: F.aggregate(blocks, zeros, lambda s, b: F.zip_with(s, b, lambda p, q: p + q))
    spread = lambda blocks: F.aggregate(blocks, F.lit(0.0), lambda s, b: s + dot(b, b))
    stat = let(by_block, lambda blocks: (m - 1) * let(sums(blocks), lambda s: dot(s, s)) / F.nullif(spread(blocks), F.lit(0.0)))
    return F.struct(whole.alias("seasons"), F.when(whole >= 2, stat).alias("stat"))


def log_gamma_half(k: Column) -> Column:
    """log of gamma(k / 2), k a whole number from 1 on: a sum of logs."""
    odd = k % 2 == 1
    return F.when(odd, 0.5 * math.log(math.pi)).otherwise(0.0) + F.aggregate(upto(1, F.ceil(k / 2) - 1), F.lit(0.0), lambda s, i: s + F.log(i - F.when(odd, 0.5).otherwise(0.0)))


def chi2_tail(x: Column, k: Column) -> Column:
    """P(chi-square with k degrees of freedom > x): the incomplete gamma function by its series, or its continued fraction."""
    return let(F.struct(x.alias("x"), k.alias("k")), lambda v: upper_gamma(v["x"], v["k"]))


def upper_gamma(x: Column, k: Column) -> Column:
    a, z = k / 2.0, x / 2.0
    front = F.exp(-z + a * F.log(z) - log_gamma_half(k))
    grown = lambda s, i: let(s["term"] * z / (a + i), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))
    series = F.aggregate(upto(1, 600), F.struct((1 / a).alias("term"), (1 / a).alias("sum")), grown, lambda s: s["sum"])
    away = lambda v: F.when(F.abs(v) > 1e-300, v).otherwise(1e-300)

    def lentz(s: Column, i: Column) -> Column:
        an, b = -i * (i - a), z + 1 - a + 2 * i
        d, c = 1 / away(an * s["d"] + b), away(b + an / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    first = 1 / away(z + 1 - a)
    fraction = F.aggregate(upto(1, 300), F.struct(F.lit(1e300).alias("c"), first.alias("d"), first.alias("h")), lentz, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(z < a + 1, F.greatest(F.lit(0.0), 1 - front * series)).when(x.isNotNull() & k.isNotNull(), front * fraction)


def t_tail(t: Column, df: Column) -> Column:
    """P(|Student's t with df degrees of freedom| > |t|): the density over the angle atan(t / sqrt(df)), by quadrature."""
    pairs = F.expr("array(" + ", ".join(f"struct({n!r}D as n, {w!r}D as w)" for n, w in RULE) + ")")
    df = df.cast("double")
    over = lambda edge: (math.pi / 2 - edge) * F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"] * F.pow(F.cos(edge + p["n"] * (math.pi / 2 - edge)), df - 1))
    return F.least(F.lit(1.0), let(F.atan(F.abs(t) / F.sqrt(df)), over) / over(F.lit(0.0)))


def seasonal(y: Column, cma: Column, m: Column, level: float = 0.05) -> Column:
    """Whether Friedman's test finds a season; false where there is no statistic."""
    return F.coalesce(chi2_tail(friedman(y, cma, m)["stat"], m - 1) <= level, F.lit(False))


def multiplicative(y: Column, cma: Column, m: Column, level: float = 0.05) -> Column:
    """Whether the seasons' ranges grow with their level: positive correlation over three whole seasons or more."""
    whole = F.floor(F.size(y) / m).cast("int")
    pairs = lambda r: F.transform(upto(0, whole - 1), lambda b: let(F.slice(r, b * m + 1, m), lambda v: F.struct((F.array_max(v) - F.array_min(v)).alias("p"), mean(F.slice(cma, b * m + 1, m)).alias("q"))))

    def grows(s: Column) -> Column:
        p, q = (let(s[c], lambda a: let(mean(a), lambda mu: F.transform(a, lambda v: v - mu))) for c in "pq")
        c = dot(p, q) / F.nullif(F.sqrt(dot(p, p) * dot(q, q)), F.lit(0.0))
        return let(c, lambda c: (c > 0) & (t_tail(c * F.sqrt((whole - 2) / F.greatest(1 - c * c, F.lit(1e-300))), whole - 2) <= level))

    found = let(F.zip_with(y, cma, lambda v, c: v - c), lambda r: let(pairs(r), grows))
    return F.coalesce(F.when((F.array_min(y) > 0) & (whole >= 3), found), F.lit(False))


def smoothing_aic(y: Column, trend: bool) -> Column:
    """n log SSE + 2k of exponential smoothing with additive errors, with or without an additive trend, as a fold over y.

    The errors are linear in the starting states, so those are solved exactly in each cell of a grid of smoothing weights: the fold
    keeps the path from zero states, its derivatives in the starting level and slope, and the sums of products of their errors. The
    grid is narrowed twice around its best cell.
    """
    names = ["l0", "l1", "l2", "s0", "s1", "s2", "c00", "c01", "c02", "c11", "c12", "c22"]
    begin = F.struct(*(F.lit({"l1": 1.0, "s2": 1.0}.get(c, 0.0)).alias(c) for c in names))

    def step(a: Column, b: Column):
        def one(s: Column, v: Column) -> Column:
            ahead = [s[f"l{i}"] + s[f"s{i}"] if trend else s[f"l{i}"] for i in range(3)]
            errors = F.struct((v - ahead[0]).alias("e0"), (-ahead[1]).alias("e1"), (-ahead[2]).alias("e2"))

            def moved(e: Column) -> Column:
                e = [e["e0"], e["e1"], e["e2"]]
                new = {f"l{i}": (a - 1) * e[i] + (v if i == 0 else 0.0) for i in range(3)} | {f"s{i}": s[f"s{i}"] + b * e[i] for i in range(3)}
                new |= {f"c{i}{j}": s[f"c{i}{j}"] + e[i] * e[j] for i in range(3) for j in range(i, 3)}
                return F.struct(*(new[c].alias(c) for c in names))

            return let(errors, moved)

        return one

    def sse(s: Column) -> Column:
        if not trend:
            return s["c00"] - s["c01"] * s["c01"] / (s["c11"] * (1 + 1e-12))
        more = 1e-12 * (s["c11"] + s["c22"])
        p, q = s["c11"] + more, s["c22"] + more
        return s["c00"] - (s["c01"] * (q * s["c01"] - s["c12"] * s["c02"]) + s["c02"] * (p * s["c02"] - s["c12"] * s["c01"])) / (p * q - s["c12"] * s["c12"])

    def cell(k: Column, g: Column) -> Column:
        i, j = k % CELLS, F.floor(k / CELLS)
        pair = F.struct((g["la"] + i * (g["ha"] - g["la"]) / (CELLS - 1)).alias("a"), ((g["ls"] + j * (g["hs"] - g["ls"]) / (SHARES - 1)) if trend else F.lit(0.0)).alias("share"))
        value = lambda p: F.struct(F.aggregate(y, begin, step(p["a"], p["a"] * p["share"]), sse).alias("sse"), k.alias("k"), p["a"].alias("a"), p["share"].alias("share"))
        return let(pair, value)

    clip = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    least = 1e-12 * dot(y, y) + 1e-300

    def narrowed(g: Column, best: Column) -> Column:
        ends = {}
        for c, mid in (("a", best["a"]), ("s", best["share"] if trend else F.lit(0.5))):
            width = (g[f"h{c}"] - g[f"l{c}"]) / 8
            ends |= {f"l{c}": clip(mid - width, 0.001, 0.998), f"h{c}": clip(mid + width, 0.002, 0.999)}
        return F.struct(*(ends[c].alias(c) for c in ("la", "ha", "ls", "hs")), F.least(g["best"], F.greatest(best["sse"], least)).alias("best"))

    grid = F.struct(*(F.lit(v).alias(c) for c, v in (("la", 0.01), ("ha", 0.99), ("ls", 0.01), ("hs", 0.99), ("best", math.inf))))
    cells = upto(0, CELLS * (SHARES if trend else 1) - 1)
    found = F.aggregate(upto(1, ROUNDS), grid, lambda g, _: let(F.array_min(F.transform(cells, lambda k: cell(k, g))), lambda best: narrowed(g, best)), lambda g: g["best"])
    return F.size(y) * F.log(found) + 2 * (4 if trend else 2)


def trending(cma: Column) -> Column:
    """Whether smoothing with a trend explains the centred average better, by AIC."""
    unit = let(mean(cma), lambda mu: let(F.transform(cma, lambda v: v - mu), lambda d: let(F.sqrt(dot(d, d) / F.size(d)), lambda sd: F.transform(d, lambda v: v / sd))))
    better = let(unit, lambda z: smoothing_aic(z, False) > smoothing_aic(z, True))
    return F.when((F.size(cma) < 4) | (F.array_min(cma) == F.array_max(cma)), False).otherwise(better)


def season_columns(at: Column, m: Column, kind: Column) -> Column:
    """Dummies of step at (from 0): m - 1 indicators (bin), or the first sine and cosine."""
    angle = 2 * math.pi * F.pmod(at.cast("double"), m) / m
    waves = F.when(m == 2, F.array(F.cos(angle))).otherwise(F.array(F.sin(angle), F.cos(angle)))
    return F.when(kind == "bin", F.transform(upto(1, m - 1), lambda s: (F.pmod(at.cast("double"), m) == s).cast("double"))).otherwise(waves)


def layer_output(x: Column, w: Column) -> Column:
    """Biases plus inputs times weights, for a matrix whose first row has the biases."""
    weighted = F.zip_with(x, F.slice(w, F.lit(2), F.size(x)), lambda v, row: F.transform(row, lambda u: u * v))
    return F.aggregate(weighted, F.get(w, F.lit(0)), lambda s, r: F.zip_with(s, r, lambda p, q: p + q))


def network(x: Column, member: Column) -> Column:
    """The output of a member (activation, layers, direct) for inputs x; null where one of these is null."""
    layers, straight = member["layers"], member["direct"]
    active = lambda v: F.when(member["activation"] == "softsign", v / (1 + F.abs(v))).otherwise(0.5 * (F.tanh(0.5 * v) + 1))
    hidden = F.aggregate(F.slice(layers, F.lit(1), F.size(layers) - 1), x, lambda a, w: F.transform(layer_output(a, w), active))
    out = let(hidden, lambda a: F.get(layer_output(a, F.element_at(layers, -1)), F.lit(0)))
    return F.when(~F.exists(x, lambda v: v.isNull()), out + F.when(F.size(straight) > 0, dot(x, straight)).otherwise(0.0))
