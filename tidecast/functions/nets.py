"""Feed-forward networks in numpy: extreme learning machines and perceptrons trained by resilient propagation.

A network is a list of layers, each a matrix with the biases in its first row; the last layer is linear. An extreme learning
machine may also have weights straight from the inputs.
"""

from __future__ import annotations

import numpy as np

from tidecast.functions import stats

ACTIVATIONS = {"softsign": lambda x: x / (1 + np.abs(x)), "logistic": lambda x: 0.5 * (np.tanh(0.5 * x) + 1)}


def hidden_output(x: np.ndarray, layers: list[np.ndarray], activation: str) -> np.ndarray:
    for w in layers:
        x = ACTIVATIONS[activation](w[0] + x @ w[1:])
    return x


def forward(x: np.ndarray, layers: list[np.ndarray], direct: np.ndarray, activation: str) -> np.ndarray:
    out = layers[-1][0, 0] + hidden_output(x, layers[:-1], activation) @ layers[-1][1:, 0]
    return out + x @ direct if len(direct) else out


def random_layer(p: int, hidden: int, ortho: bool, rng: np.random.Generator) -> np.ndarray:
    """Uniform weights within 1/sqrt(p), biases first; ortho: orthonormal columns where there are rows enough."""
    w = rng.uniform(-1, 1, (p + 1, hidden)) / np.sqrt(max(p, 1))
    if ortho and p + 1 >= hidden:
        u, _, v = np.linalg.svd(w, full_matrices=False)
        w = u @ v
    return w


def random_layers(p: int, hidden: tuple[int, ...], barebone: bool, ortho: bool, rng: np.random.Generator) -> list[np.ndarray]:
    """barebone: one uniform layer for softsign neurons; otherwise normal weights for logistic ones, in any number of layers."""
    if barebone:
        return [random_layer(p, hidden[0], ortho, rng)]
    return [rng.normal(size=(i + 1, o)) for i, o in zip((p, *hidden[:-1]), hidden, strict=True)]


def output_weights(folds: list[np.ndarray], kind: str, rule: str = "1se") -> np.ndarray:
    """Intercept and weights of the output layer from the moments of (features, y) by fold; rule as in stats.cross_validated."""
    if kind == "lasso":
        return stats.cross_validated(folds, stats.lasso_path, rule=rule)
    if kind == "ridge":
        return stats.cross_validated(folds, stats.ridge_path, rule=rule)
    return stats.least_squares(sum(folds), kind == "step")[0]


def pruned(layers: list[np.ndarray], w: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(layers with the output layer added and neurons of weight 0 left out, direct weights)."""
    k = layers[-1].shape[1]
    alive = w[1 : 1 + k] != 0
    return [*layers[:-1], layers[-1][:, alive], np.concatenate([w[:1], w[1 : 1 + k][alive]])[:, None]], w[1 + k :]


class Elm:
    """An extreme learning machine whose output weights come from sums over steps that are added as they come, n in all.

    Random hidden layers (a size of 0: none, the output weights are on the inputs alone, which takes direct); the output weights by
    lasso, ridge, step or least squares (ls or lm).
    """

    def __init__(self, p: int, n: int, hidden: tuple[int, ...] | None, kind: str, direct: bool, rng: np.random.Generator, barebone: bool = True, ortho: bool = False, rule: str = "1se"):
        hidden = hidden or (min(100 - 60 * (kind in ("step", "ls", "lm")), max(4, n - 2 - direct * p)),)
        self.layers = random_layers(p, hidden, barebone, ortho, rng)
        self.activation, self.kind, self.direct, self.rule = "softsign" if barebone else "logistic", kind, direct, rule
        self.fold, self.seen = rng.permutation(n) % min(5, n), 0
        self.sums = {}

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        z = hidden_output(x, self.layers, self.activation)
        z = np.hstack([z, x]) if self.direct else z
        fold = self.fold[self.seen : self.seen + len(y)]
        for f in np.unique(fold):
            self.sums[f] = self.sums.get(f, 0.0) + stats.moments(z[fold == f], y[fold == f])
        self.seen += len(y)

    def solve(self) -> tuple[list[np.ndarray], np.ndarray]:
        return pruned(self.layers, output_weights([m for _, m in sorted(self.sums.items())], self.kind, self.rule))


def slopes(x: np.ndarray, y: np.ndarray, w: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    """Squared error of a perceptron's layers w over some rows, and the slopes of half of it; both add up over parts of a table."""
    one, seen = np.ones((len(y), 1)), [np.hstack([np.ones((len(y), 1)), x])]
    for a in w[:-1]:
        seen.append(np.hstack([one, ACTIVATIONS["logistic"](seen[-1] @ a)]))
    d, out = seen[-1] @ w[-1] - y[:, None], []
    sse = float((d * d).sum())
    for i in range(len(w) - 1, -1, -1):
        out.append(seen[i].T @ d)
        d = (d @ w[i][1:].T) * seen[i][:, 1:] * (1 - seen[i][:, 1:]) if i else d
    return sse, out[::-1]


class Propagation:
    """Resilient propagation with weight backtracking: each weight has a step of its own, which grows while its slope keeps its sign.

    Logistic hidden layers, a linear output. settled: no slope was as large as threshold. best: the layers of least error so far.
    """

    def __init__(self, inputs: int, hidden: tuple[int, ...], rng: np.random.Generator, start: list[np.ndarray] | None = None):
        sizes = (inputs, *hidden, 1)
        self.w = [a.copy() for a in start] if start else [rng.normal(0, 0.7 if i + 2 < len(sizes) else 0.3, (sizes[i] + 1, sizes[i + 1])) for i in range(len(sizes) - 1)]
        self.step, self.before, self.moved = [np.full(a.shape, 0.05) for a in self.w], [np.zeros(a.shape) for a in self.w], [np.zeros(a.shape) for a in self.w]
        self.best, self.least, self.settled = [a.copy() for a in self.w], np.inf, False

    def update(self, sse: float, found: list[np.ndarray], threshold: float = 0.01) -> None:
        if sse < self.least:
            self.least, self.best = sse, [a.copy() for a in self.w]
        self.settled = max(float(np.abs(g).max()) for g in found) < threshold
        if self.settled:
            return
        for i, g in enumerate(found):
            turned = g * self.before[i] < 0
            self.step[i] = np.clip(self.step[i] * np.where(turned, 0.5, np.where(g * self.before[i] > 0, 1.2, 1)), 1e-10, 5)
            # where a slope has turned, its last move is taken back
            self.moved[i] = np.where(turned, -self.moved[i], -np.sign(g) * self.step[i])
            self.w[i] += self.moved[i]
            self.before[i] = np.where(turned, 0, g)


def mlp(x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...], rng: np.random.Generator, steps: int = 2000, threshold: float = 0.01) -> tuple[list[np.ndarray], bool]:
    """Full-batch resilient propagation of half the squared error: the best layers, and whether it settled within `steps` steps."""
    p = Propagation(x.shape[1], hidden, rng)
    for _ in range(steps):
        p.update(*slopes(x, y, p.w), threshold)
        if p.settled:
            break
    return p.best, p.settled
