"""Small statistics in numpy: distribution tails, penalised and stepwise regression from moment matrices, density mode."""

from __future__ import annotations

import math

import numpy as np


def chi2_tail(x: float, k: float) -> float:
    """P(chi-square with k degrees > x), by series or continued fraction of the incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if abs(an * d + b) > 1e-300 else 1e-300)
        c = b + an / c if abs(b + an / c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_tail(t: float, df: float) -> float:
    """P(|Student's t with df degrees| > |t|), by quadrature of the density in the angle atan(t / sqrt(df))."""
    if df <= 0 or not math.isfinite(t):
        return 0.0 if df > 0 else 1.0
    edge = math.atan(abs(t) / math.sqrt(df))
    nodes, weights = np.polynomial.legendre.leggauss(64)
    angle = edge + (nodes + 1) / 2 * (math.pi / 2 - edge)
    front = 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return float(min(1.0, front * (weights @ np.cos(angle) ** (df - 1)) * (math.pi / 2 - edge) / 2))


# Regression from moments. A moment matrix is A'A of the rows a = (1, columns..., y): moments of parts of a table add up,
# so a table of any length is fitted from sums.


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a = np.hstack([np.ones((len(y), 1)), x, y[:, None]])
    return a.T @ a


def centred(m: np.ndarray) -> tuple:
    """(n, column means, mean of y, covariance, covariance with y, variance of y) of a moment matrix, or of a stack of them."""
    n = m[..., 0, 0]
    mean = m[..., 0, 1:] / n[..., None]
    c = m[..., 1:, 1:] / n[..., None, None] - mean[..., :, None] * mean[..., None, :]
    return n, mean[..., :-1], mean[..., -1], c[..., :-1, :-1], c[..., :-1, -1], c[..., -1, -1]


def error(m: np.ndarray, w: np.ndarray) -> float:
    """Mean squared error of the coefficients w (intercept first) over the rows of m."""
    v = np.append(w, -1.0)
    return float(v @ m @ v / m[0, 0])


def with_intercept(w: np.ndarray, mx: np.ndarray, my: np.ndarray) -> np.ndarray:
    return np.concatenate([my[:, None, None] - w @ mx[:, :, None], w], 2)


def ridge_path(m: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """Coefficients (matrix of the stack m, penalty, coefficient), intercept first and not penalised."""
    _, mx, my, g, c, _ = centred(m)
    values, vectors = np.linalg.eigh(g)
    turned = vectors.swapaxes(1, 2) @ c[:, :, None]
    return with_intercept((vectors @ (turned / (np.maximum(values, 0)[:, :, None] + penalties))).swapaxes(1, 2), mx, my)


def lasso_path(m: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """As ridge_path, for (1/2n) RSS + penalty * sum |w|: exact at every penalty, by the homotopy of each matrix of the stack."""
    _, mx, my, g, c, _ = centred(m)
    return with_intercept(np.stack([homotopy(own, right, penalties) for own, right in zip(g, c, strict=True)]), mx, my)


def homotopy(g: np.ndarray, c: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """Minimisers of w'gw/2 - c'w + penalty * sum |w|, a row for each penalty; g may be singular.

    From the largest penalty down, the minimiser is linear in the penalty until a column joins (its slope c - gw reaches the penalty)
    or leaves (its weight reaches 0), so the path ends after finitely many events (Osborne, Presnell and Turlach 2000). A
    column that depends on the active ones keeps its slope in proportion to the penalty and never has to join. What fails the
    optimality conditions, as events at one and the same place might, is done again with slopes set apart by one part in 10**9.
    """
    spread = np.sqrt(np.maximum(np.diag(g), 0))
    live = np.flatnonzero(spread > 1e-9 * max(spread.max(initial=0), 1e-300))
    out = np.zeros((len(penalties), len(c)))
    if not len(live):
        return out
    # columns of one size, each with a penalty of its own
    size = spread[live]
    g, c, weight = g[np.ix_(live, live)] / size / size[:, None], c[live] / size, 1 / size
    weight = weight / (unit := weight.max())
    for shift in range(4):
        apart = 1 + 1e-9 * shift * np.cos(1.7 * np.arange(len(c)) + shift)
        found = np.array(list(events(g, c * apart, weight, penalties * unit)))
        if off_optimum(g, c, weight, penalties * unit, found) < 1e-6 * max(float(np.abs(c).max()), 1e-300):
            out[:, live] = found / size
            return out
    raise ArithmeticError("the lasso path doesn't meet its optimality conditions")


def off_optimum(g: np.ndarray, c: np.ndarray, weight: np.ndarray, penalties: np.ndarray, w: np.ndarray) -> float:
    """By how much rows of w miss the optimality conditions: slopes are at the penalty where w isn't 0, and nowhere beyond it."""
    slope, limit = c - w @ g, penalties[:, None] * weight
    return float(np.where(w != 0, np.abs(slope - np.sign(w) * limit), np.maximum(np.abs(slope) - limit, 0)).max(initial=0))


def events(g: np.ndarray, c: np.ndarray, weight: np.ndarray, penalties: np.ndarray):
    """Yields the weights at each of the penalties, which come in any order, largest first wanted."""
    order = np.argsort(-penalties, kind="stable")
    found, p, asked = np.zeros((len(penalties), len(c))), len(c), 0
    active, sign, barred = [], np.zeros(p), np.zeros(p, bool)
    now = float((np.abs(c) / weight).max())
    while asked < len(order) and penalties[order[asked]] >= now:
        asked += 1
    for _ in range(1000 + 50 * p):
        if asked == len(order):
            break
        # on this piece w = u - penalty * v on the active columns, and slopes are at + penalty * rise
        a = np.array(active, int)
        u, v = np.linalg.solve(g[np.ix_(a, a)], np.stack([c[a], sign[a] * weight[a]], 1)).T if len(a) else (c[:0], c[:0])
        at, rise = c - g[:, a] @ u, g[:, a] @ v
        nearest, event = 0.0, None
        idle = ~barred
        idle[a] = False
        for side in (1.0, -1.0):
            # side * (at + penalty * rise) = penalty * weight; it must go outwards as the penalty falls
            gap = weight - side * rise
            with np.errstate(divide="ignore", invalid="ignore"):
                meets = np.where(idle & (gap > 1e-9), side * at / gap, -1.0)
            meets = np.where(meets > now * (1 - 1e-12), np.where(meets < now * (1 + 1e-6), now, -1.0), meets)
            j = int(meets.argmax())
            if meets[j] > nearest:
                nearest, event = float(meets[j]), (j, side)
        if len(a):
            falls = sign[a] * v < -1e-12  # the weight shrinks as the penalty falls
            with np.errstate(divide="ignore", invalid="ignore"):
                ends = np.where(falls, np.minimum(u / v, now), -1.0)
            k = int(ends.argmax())
            if ends[k] >= nearest and ends[k] > 0:
                nearest, event = float(ends[k]), (int(a[k]), 0.0)
        while asked < len(order) and penalties[order[asked]] >= nearest:
            found[order[asked], a] = u - penalties[order[asked]] * v
            asked += 1
        if event is None:
            break
        now, (j, side) = nearest, event
        if side == 0.0:
            active.remove(j)
            sign[j] = 0.0
            barred[:] = False
        elif left_over(g, a, j) > 1e-9:
            active.append(j)
            sign[j] = side
        else:
            barred[j] = True  # a mix of the active ones up to rounding, until one of those leaves
    yield from found


def left_over(g: np.ndarray, a: np.ndarray, j: int) -> float:
    """The part of column j that the columns a don't explain, as a share."""
    return float(g[j, j] - g[j, a] @ np.linalg.solve(g[np.ix_(a, a)], g[a, j])) if len(a) else 1.0


def fold_paths(folds: list[np.ndarray], path, count: int = 20) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(penalties, coefficients (all rows and then all but each fold, penalty, coefficient), the folds that can be held out)."""
    whole = sum(folds)
    top = max(float(np.abs(centred(whole)[4]).max(initial=0)), 1e-12)
    penalties = top * np.geomspace(1, 1e-4, count)
    out = [k for k, f in enumerate(folds) if f[0, 0] > 0 and (whole - f)[0, 0] > 1]
    return penalties, path(np.stack([whole, *(whole - folds[k] for k in out)]), penalties), out


def pick(errors: np.ndarray, rule: str = "1se") -> int:
    """The penalty (of those in descending order) for errors (fold, penalty): the largest whose mean error is within one standard
    error of the least (1se), or that of the least (min)."""
    mean, se = errors.mean(0), errors.std(0) / math.sqrt(len(errors))
    best = int(mean.argmin())
    return best if rule == "min" else int(np.flatnonzero(mean <= mean[best] + se[best])[0])


def cross_validated(folds: list[np.ndarray], path, count: int = 20, rule: str = "1se") -> np.ndarray:
    """Coefficients at the penalty that rule picks by the errors over the held-out folds; without such folds, at the largest."""
    _, paths, out = fold_paths(folds, path, count)
    if not out:
        return paths[0, 0]
    return paths[0, pick(np.array([[error(folds[k], w) for w in p] for k, p in zip(out, paths[1:], strict=True)]), rule)]


def independent(g: np.ndarray) -> list[int]:
    """Columns of a covariance that aren't combinations of the ones before them."""
    left, own = g.astype(float).copy(), []
    for j in range(len(g)):
        if left[j, j] > 1e-9 * max(g[j, j], 1e-300):
            own.append(j)
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
    return own


def least_squares(m: np.ndarray, step: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients with the intercept first, two-sided p-values of the columns); step: after backward selection by AIC.

    Columns that are combinations of others get 0, and p-value 1.
    """
    n, mx, my, g, c, vy = centred(m)
    own = independent(g)
    while True:
        inverse = np.linalg.pinv(g[np.ix_(own, own)], hermitian=True)
        beta = inverse @ c[own]
        rss = max(vy - float(beta @ c[own]), 1e-12 * max(vy, 1e-300))
        if not step or not own:
            break
        cost = beta**2 / np.maximum(np.diag(inverse), 1e-300)  # rise of rss when a column goes
        out = int(cost.argmin())
        if n * math.log((rss + cost[out]) / rss) >= 2:
            break
        own.pop(out)
    w, p = np.zeros(len(g) + 1), np.ones(len(g))
    w[0], df = my, n - len(own) - 1
    if own:
        w[0] = my - mx[own] @ beta
        w[1 + np.array(own)] = beta
        if df > 0:
            se = np.sqrt(rss * np.maximum(np.diag(inverse), 1e-300) / df)
            p[own] = [t_tail(float(t), df) for t in beta / se]
    return w, p


def sweep(m: np.ndarray, k: int, back: bool = False) -> None:
    """Sweeps row and column k of m in place (Goodnight 1979), or undoes that."""
    d, row, column = m[k, k], m[k].copy(), m[:, k].copy()
    m -= np.outer(column, row) / d
    m[k], m[:, k] = row / d, column / d
    if back:
        m[k], m[:, k] = -m[k], -m[:, k]
    m[k, k] = -1 / d


def swept(m: np.ndarray, blocks: list[list[int]], keep: set[int] = frozenset()) -> list[int]:
    """Blocks of columns that backward selection by AIC leaves of a moment matrix; those in keep are never dropped.

    The matrix is swept once; from then on what a block explains is read off it, and a dropped block is swept back. Columns
    that depend on others count as columns but explain nothing; they are swept in when what they depend on goes.
    """
    n, end = m[0, 0], len(m) - 1
    a = m.copy()
    size = np.sqrt(np.maximum(np.diag(a), 1e-300))
    a /= np.outer(size, size)
    sweep(a, 0)
    spread, least = np.diag(a).copy(), max(1e-13 * a[end, end], 1e-300)
    held, inside = list(range(len(blocks))), set()

    def enter(a: np.ndarray, inside: set[int], some: list[int]) -> None:
        for b in some:
            for j in blocks[b]:
                if 1 + j not in inside and a[1 + j, 1 + j] > 1e-10 * max(spread[1 + j], 1e-300):
                    sweep(a, 1 + j)
                    inside.add(1 + j)

    def without(out: int) -> tuple[np.ndarray, set[int]]:
        b, left = a.copy(), set(inside)
        for j in blocks[out]:
            if 1 + j in left:
                sweep(b, 1 + j, True)
                left.discard(1 + j)
        enter(b, left, [h for h in held if h != out])
        return b, left

    score = lambda a, some: n * math.log(max(a[end, end], least)) + 2 * sum(len(blocks[b]) for b in some)
    enter(a, inside, held)
    now = score(a, held)
    while True:
        tries = [(score(without(out)[0], [h for h in held if h != out]), out) for out in held if out not in keep]
        if not tries or min(tries)[0] >= now:
            return held
        now, out = min(tries)
        a, inside = without(out)
        held.remove(out)


def bandwidth(v: np.ndarray) -> float:
    """The plug-in width that solves Sheather and Jones's (1991) equation; the rule of thumb where it has no root."""
    n, sd = len(v), v.std(ddof=1)
    scale = min(sd, np.subtract(*np.percentile(v, [75, 25])) / 1.349) or sd
    rule = 0.9 * scale * n**-0.2
    gaps = (v[:, None] - v) ** 2

    def fourth(h: float) -> float:
        d = gaps / h**2
        return float((np.exp(-d / 2) * (d * d - 6 * d + 3)).sum()) / (n * (n - 1) * h**5 * math.sqrt(2 * math.pi))

    def sixth(h: float) -> float:
        d = gaps / h**2
        return -float((np.exp(-d / 2) * (d**3 - 15 * d * d + 45 * d - 15)).sum()) / (n * (n - 1) * h**7 * math.sqrt(2 * math.pi))

    down, up = fourth(1.24 * scale * n ** (-1 / 7)), sixth(1.23 * scale * n ** (-1 / 9))
    if not (down > 0 and up > 0):
        return rule
    ratio = 1.357 * (down / up) ** (1 / 7)

    def gap(h: float) -> float:
        s = fourth(ratio * h ** (5 / 7))
        return (1 / (2 * math.sqrt(math.pi) * n * s)) ** 0.2 - h if s > 0 else math.nan

    high = 1.144 * scale * n**-0.2
    low = 0.1 * high
    if not gap(low) * gap(high) < 0:
        return rule
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if gap(mid) * gap(low) > 0 else (low, mid)
    return (low + high) / 2


def density_mode(values: np.ndarray, points: int = 512) -> float:
    """First maximum of a Gaussian kernel density on the range widened by a tenth; the value itself where all are equal."""
    v = np.asarray(values, float)
    low, high = v.min(), v.max()
    if low == high:
        return float(v[0])
    grid = np.linspace(low - 0.1 * (high - low), high + 0.1 * (high - low), points)
    return float(grid[np.exp(-0.5 * ((grid[:, None] - v) / bandwidth(v)) ** 2).sum(1).argmax()])
