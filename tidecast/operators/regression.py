"""Extreme learning machines for tables of any length, by group: hidden layers are drawn from a seed, so every partition makes the
same features, and the output weights need only sums of products, which partitions add up. No group is brought into one task.

A task adds up the products of all its rows before it gives any, and the sums of a member meet in one task as a sorted stream of
short pieces, which it adds as they come. So what is shuffled depends on partitions, groups and neurons, not on rows.

A logistic output is fitted by reweighted least squares: each pass over the table gives the sums of products of a working
response, so a pass costs what a linear fit does. While weights settle, the penalty or the selected columns are chosen anew on those
(Gu 1992). Then the penalty of lasso and ridge is chosen by deviance: the settled sums give the paths without each fold, one pass adds
up the deviance of the rows left out along their paths, and the weights settle once more at the penalty of least deviance, or
the largest within one standard error of it. The scaled table is written once, by blocks of groups, and a pass reads its block alone.

Rows meet their group's ranges where they are: those of frequent groups go to every task, so that no group's rows are shuffled to one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidecast.functions import arrays as A
from tidecast.functions import nets, stats
from tidecast.functions.stats import density_mode
from tidecast.functions.transforms import softsign
from tidecast.sources.written import discard, materialise

FOLDS = 5
#: Models of at most this many weights (8 bytes each) go to every task; larger ones are joined to the rows.
SMALL = 4_000_000
#: Most passes over the table for a logistic output, the least weight of a row in one, and the change that ends them.
PASSES, LEAST_WEIGHT, SETTLED = 25, 1e-5, 1e-4
#: Bytes of sums that a task holds before it gives them, and numbers in a piece of a sum.
HELD_BYTES, PIECE = 64 << 20, 512
WEIGHTS = "g string, rep int, w_in array<array<double>>, w_out array<double>, direct array<double>, settled boolean"


def to_range(x: Column, low: Column, high: Column) -> Column:
    """x from [low, high] to [-1, 1]; 0 where the column is constant."""
    return F.when(high > low, 2 * (x - low) / F.nullif(high - low, F.lit(0.0)) - 1).when(x.isNotNull(), F.lit(0.0))


def as_array(x: list[str] | str) -> Column:
    """The inputs as one array, null where one is missing or not a number: columns, or a column of arrays."""
    v = F.col(x).cast("array<double>") if isinstance(x, str) else F.array(*(F.col(c).cast("double") for c in x))
    return F.when(~F.exists(v, lambda u: u.isNull() | F.isnan(u)), v)


def ranges(rows: DataFrame, p: int) -> DataFrame:
    """(g, low, high, n): least and greatest values of y, then of each input, by group, and its rows; summed up in every task before the shuffle."""
    each = rows.select("g", F.posexplode(F.concat(F.array("y"), "x")).alias("i", "v")).groupBy("g", "i").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    packed = each.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("e"), F.max("n").alias("n"))
    return packed.select("g", F.col("e.low").alias("low"), F.col("e.high").alias("high"), "n")


def beside_ranges(rows: DataFrame, ends: DataFrame, p: int, most: int = SMALL) -> DataFrame:
    """rows with their group's low and high. At most `most` numbers go to every task: all groups' or, where these are more, those of
    the groups with the most rows; the others, each with a small share of the rows, are joined by a shuffle."""
    sent = max(1, most // (2 * (p + 1)))
    groups, total = ends.agg(F.count(F.lit(1)), F.sum("n")).first()
    if groups <= sent:
        return rows.join(F.broadcast(ends.drop("n")), "g")
    hot = F.broadcast(ends.where(F.col("n") > total / sent).drop("n"))  # fewer than sent
    rest = rows.join(hot.select("g"), "g", "left_anti")
    return rows.join(hot, "g").unionByName(rest.join(ends.drop("n"), "g"))


def by_blocks(ready: DataFrame, blocks: int) -> tuple[DataFrame, list[DataFrame]]:
    """The scaled table as written, and its rows by block of groups. A single block is written as it comes, without a sort."""
    if blocks == 1:
        written = materialise(ready, "scaled")
        return written, [written]
    written = materialise(ready.withColumn("block", F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int")), "scaled", "block")
    return written, [written.where(F.col("block") == k) for k in range(blocks)]


def scaled_rows(table: DataFrame, group: str, y: str, x: list[str] | str, scale: bool = True, least: float = -1.0) -> tuple[DataFrame, DataFrame, int]:
    """(rows (g, fold, y, x) with all values between -1 and 1, their ranges and counts (g, low, high, n) as written, inputs); folds are by a hash of a row's values.

    Without scale, y is taken to lie between `least` and 1 and inputs between -1 and 1 already.
    """
    rows = table.select(F.col(group).cast("string").alias("g"), F.nanvl(F.col(y).cast("double"), F.lit(None)).alias("y"), as_array(x).alias("x")).dropna()
    p = len(x) if not isinstance(x, str) else (rows.agg(F.max(F.size("x"))).first()[0] or 0)
    rows = rows.where(F.size("x") == p)
    if scale and isinstance(x, str):
        ends = ranges(rows, p)
    elif scale:
        names = [F.col("y"), *(F.get("x", F.lit(i)) for i in range(p))]
        ends = rows.groupBy("g").agg(F.array(*(F.min(c) for c in names)).alias("low"), F.array(*(F.max(c) for c in names)).alias("high"), F.count(F.lit(1)).alias("n"))
    else:
        ends = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).select("g", F.concat(F.array(F.lit(least)), F.array_repeat(F.lit(-1.0), p)).alias("low"), F.array_repeat(F.lit(1.0), p + 1).alias("high"), "n")
    ends = materialise(ends, "ranges")
    ranged = lambda v, i: to_range(v, F.get("low", i), F.get("high", i))
    fold = F.pmod(F.xxhash64("y", "x"), F.lit(FOLDS)).cast("int")
    ready = beside_ranges(rows, ends, p).select("g", fold.alias("fold"), ranged(F.col("y"), F.lit(0)).alias("y"), F.transform("x", lambda v, i: ranged(v, i + 1)).alias("x"))
    return ready, ends, p


def fit(table: DataFrame, group: str, y: str, x: list[str] | str, hidden: int = 100, kind: str = "lasso", reps: int = 20, direct: bool = False, ortho: bool = False, scale: bool = True, link: str = "linear", seed: int = 42, rule: str = "1se") -> DataFrame:
    """A row for each group: its ranges, an array of members and whether they settled. Rows with a null or NaN in y or x aren't used.

    x: columns, or the name of one column of arrays, for inputs by the hundreds; arrays of another length than the longest aren't used.
    kind: lasso, ridge, step, ls (or lm). Rows fall into the folds of lasso and ridge by a hash of their values, so equal rows
    share a fold; a group without rows gives none. rule: as in stats.cross_validated. link logistic: y lies between 0 and 1
    (between its least and greatest value when scaled) and so do predictions; it needs up to PASSES passes, twice where a penalty is
    chosen, and members whose weights still change then are kept with settled false. Groups are taken in blocks for which a
    pass sends SMALL numbers to every task on average. The result is written to the shared folder.
    """
    if link not in ("linear", "logistic"):
        raise ValueError("link is linear or logistic")
    if kind not in ("lasso", "ridge", "step", "ls", "lm"):
        raise ValueError("type is lasso, ridge, step, ls or lm")
    ready, ends, p = scaled_rows(table, group, y, x, scale, 0.0 if link == "logistic" else -1.0)
    size = 1 + hidden + (p if direct else 0) + 1
    upper = np.triu_indices(size)

    def layer(g: str, rep: int) -> np.ndarray:
        return nets.random_layer(p, hidden, ortho, np.random.default_rng([seed, zlib.crc32(g.encode()), rep]))

    def features(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = nets.hidden_output(v[:, 1:], [w], "softsign")
        return np.hstack([np.ones((len(v), 1)), z, v[:, 1:] if direct else v[:, :0]])

    def solve(g: str, rep: int, sums: dict[tuple[int, int], np.ndarray], penalty: float | None, paths: bool) -> pd.DataFrame:
        folds, counts = [], 0.0
        for f in sorted({fold for fold, _ in sums}):
            flat = np.concatenate([sums[at] for at in sorted(sums) if at[0] == f])
            m = np.zeros((size, size))
            m[upper] = flat[:-1]
            counts += flat[-1]
            folds.append(m + np.triu(m, 1).T)
        even = counts / sum(m[0, 0] for m in folds)  # weights of rows are 1 on average
        folds = [m * even for m in folds]
        along = stats.lasso_path if kind == "lasso" else stats.ridge_path
        if paths:
            penalties, found, out = stats.fold_paths(folds, along)
            numbers = sorted({fold for fold, _ in sums})
            w = np.concatenate([[len(out)], [numbers[k] for k in out], penalties, found[1:].ravel()])
        elif penalty is not None:
            w = along(sum(folds)[None], np.array([penalty]))[0, 0]
        else:
            w = nets.output_weights(folds, kind, rule)
        return pd.DataFrame([(g, rep, w.tolist())], columns=["g", "rep", "w"])

    def solver(penalties: dict, paths: bool):
        def solve_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, sums = None, {}
            for batch in batches:
                for at, part in batch.groupby(["g", "rep"], sort=False):
                    if at != now:
                        if now is not None:
                            yield solve(now[0], int(now[1]), sums, penalties.get(now), paths)
                        now, sums = at, {}
                    for key, own in part.groupby(["fold", "piece"], sort=False):
                        sums[key] = sums.get(key, 0.0) + np.sum(np.stack(own["m"].to_list()), axis=0)
            if now is not None:
                yield solve(now[0], int(now[1]), sums, penalties.get(now), paths)

        return solve_stream

    def pieces(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (g, rep, fold), flat in held.items():
            cuts = np.arange(0, len(flat), PIECE, dtype=np.int32)
            same = [pa.array([v] * len(cuts), kind) for v, kind in ((g, pa.string()), (rep, pa.int32()), (fold, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(cuts // PIECE), pa.ListArray.from_arrays(np.append(cuts, np.int32(len(flat))), pa.array(flat))], names=["g", "rep", "fold", "piece", "m"])

    def solved(some: DataFrame, before: Broadcast | None, penalties: dict | None = None, paths: bool = False) -> DataFrame:
        """(g, rep, w): output weights; for a logistic output, a step on from those before. penalties: at these, by member, instead
        of chosen ones; paths: instead, the folds that can be held out, the penalties and the weights without each fold at each."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}
            drawn: dict[tuple[str, int], np.ndarray] = {}
            for batch in batches:
                if len(drawn) * (p + 1) * hidden * 8 > HELD_BYTES:
                    drawn.clear()
                codes, found = pd.factorize(batch.column("g").to_pandas())
                inputs = np.hstack([batch.column("y").to_numpy()[:, None], batch.column("x").flatten().to_numpy().reshape(batch.num_rows, p)])
                folds = batch.column("fold").to_numpy()
                for k, g in enumerate(found):
                    mine = codes == k
                    v, fold = inputs[mine], folds[mine]
                    by_fold = [(int(f), fold == f) for f in np.unique(fold)]
                    for rep in range(reps):
                        if (g, rep) not in drawn:
                            drawn[g, rep] = layer(g, rep)
                        a, target = features(v, drawn[g, rep]), v[:, :1]
                        a = working(a, target, before.value.get((g, rep)) if before else None) if link == "logistic" else np.hstack([a, target])
                        for f, own in by_fold:
                            flat = np.append((a[own].T @ a[own])[upper], own.sum())
                            held[g, rep, f] = held[g, rep, f] + flat if (g, rep, f) in held else flat
                    if len(held) * (len(upper[0]) + 1) * 8 > HELD_BYTES:
                        yield from pieces(held)
                        held = {}
            if held:
                yield from pieces(held)

        parts = some.select("g", "fold", "y", "x").mapInArrow(sums, "g string, rep int, fold int, piece int, m array<double>")
        return parts.repartition("g", "rep").sortWithinPartitions("g", "rep").mapInPandas(solver(penalties or {}, paths), "g string, rep int, w array<double>")

    def rounds(own: DataFrame, held: dict, penalties: dict | None) -> tuple[dict, dict, Broadcast]:
        """Passes from the weights held until nothing changes: (weights, their last changes, weights as they were sent)."""
        sent = own.sparkSession.sparkContext.broadcast(held) if held else None
        changes = {}
        for _ in range(PASSES):
            new = {(r.g, r.rep): np.array(r.w) for r in solved(own, sent, penalties).collect()}
            changes = {at: float(np.abs(w - held.get(at, 0.0)).max()) for at, w in new.items()}
            held = new
            if sent:
                sent.destroy()
            sent = own.sparkSession.sparkContext.broadcast(held)
            if all(c < SETTLED for c in changes.values()):
                break
        return held, changes, sent

    def deviances(own: DataFrame, paths: Broadcast) -> dict:
        """{(g, rep): deviance per row (fold, penalty)} of the rows of each fold along the path that was made without it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                codes, found = pd.factorize(batch.column("g").to_pandas())
                v = np.hstack([batch.column("y").to_numpy()[:, None], batch.column("x").flatten().to_numpy().reshape(batch.num_rows, p)])
                folds = batch.column("fold").to_numpy()
                for k, g in enumerate(found):
                    for rep in range(reps):
                        numbers, _, w = paths.value[g, rep]
                        a = features(v[codes == k], layer(g, rep))
                        for i, f in enumerate(numbers):
                            mine = folds[codes == k] == f
                            eta, target = a[mine] @ w[i].T, (v[codes == k][mine, :1] + 1) / 2
                            dev = np.append(2 * (np.logaddexp(0, eta) - target * eta).sum(0), mine.sum())
                            sums[g, rep, f] = sums.get((g, rep, f), 0.0) + dev
            for (g, rep, f), dev in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([rep], pa.int32()), pa.array([f], pa.int32()), pa.array([dev.tolist()], pa.list_(pa.float64()))], names=["g", "rep", "fold", "d"])

        each = own.select("g", "fold", "y", "x").mapInArrow(run, "g string, rep int, fold int, d array<double>").select("g", "rep", "fold", F.posexplode("d").alias("k", "d"))
        out: dict[tuple, dict] = {}
        for r in each.groupBy("g", "rep", "fold", "k").agg(F.sum("d").alias("d")).collect():  # fewer than the paths have weights
            out.setdefault((r.g, r.rep), {})[r.fold, r.k] = r.d
        found = {}
        for at, own_ in out.items():
            last = max(k for _, k in own_)
            numbers = sorted({f for f, _ in own_})
            found[at] = np.array([[own_[f, k] / max(own_[f, last], 1) for k in range(last)] for f in numbers])
        return found

    def settle(own: DataFrame) -> DataFrame:
        """(g, rep, w, settled) of one block by passes until nothing changes."""
        held, changes, sent = rounds(own, {}, None)
        if kind in ("lasso", "ridge") and held:
            paths = {}
            for r in solved(own, sent, None, True).collect():
                flat, n = np.array(r.w), int(r.w[0])
                numbers, rest = [int(f) for f in flat[1 : 1 + n]], flat[1 + n :]
                count = len(rest) // (1 + n * (size - 1))
                paths[r.g, r.rep] = numbers, rest[:count], rest[count:].reshape(n, count, size - 1)
            gone = own.sparkSession.sparkContext.broadcast(paths)
            errors = deviances(own, gone)
            gone.destroy()
            penalties = {at: float(p_[stats.pick(errors[at], rule)]) if at in errors else float(p_[0]) for at, (_, p_, _) in paths.items()}
            sent.destroy()
            held, changes, sent = rounds(own, held, penalties)
        if sent:
            sent.destroy()
        rows = [(g, rep, w.tolist(), changes[g, rep] < SETTLED) for (g, rep), w in held.items()]
        return own.sparkSession.createDataFrame(rows, "g string, rep int, w array<double>, settled boolean")

    def as_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                layers, straight = nets.pruned([layer(r.g, r.rep)], np.array(r.w, float))
                out.append((r.g, r.rep, layers[0].tolist(), layers[1][:, 0].tolist(), straight.tolist(), r.settled))
            yield pd.DataFrame(out, columns=["g", "rep", "w_in", "w_out", "direct", "settled"])

    if link == "linear":
        weights = solved(ready, None).withColumn("settled", F.lit(True))
    else:
        # the paths of all folds at all penalties are the most that a pass sends to every task
        blocks = max(1, -(-ends.count() * reps * (size - 1) * (20 * FOLDS if kind in ("lasso", "ridge") else 1) // SMALL))
        written, own = by_blocks(ready, blocks)
        each = [materialise(settle(some), "weights") for some in own]
        discard(written)
        weights = each[0]
        for more in each[1:]:
            weights = weights.unionByName(more)
    members = weights.mapInPandas(as_members, WEIGHTS).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("rep", "w_in", "w_out", "direct"))).alias("members"), F.min("settled").alias("settled"))
    out = materialise(members.join(ends.drop("n"), "g").withColumn("link", F.lit(link)).withColumn("kind", F.lit(kind)), "models")
    discard(ends)
    if link == "logistic":
        discard(*each)
    return out


def working(a: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    """Rows (a, working response) of a logistic fit at the weights w, times the roots of their weights; y from -1 to 1."""
    eta = np.clip(a @ (np.zeros(a.shape[1]) if w is None else w), -15, 15)[:, None]
    p = 0.5 * (np.tanh(0.5 * eta) + 1)
    v = np.maximum(p * (1 - p), LEAST_WEIGHT)
    return np.hstack([a, eta + ((y + 1) / 2 - p) / v]) * np.sqrt(v)


def output(x: Column, member: Column) -> Column:
    """A member's output for an array of scaled inputs."""
    w, out, straight = member["w_in"], member["w_out"], member["direct"]
    add = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    weighted = F.zip_with(x, F.slice(w, 2, F.size(x)), lambda v, row: F.transform(row, lambda u: u * v))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    hidden = F.transform(F.aggregate(weighted, w[0], add), softsign)
    through = total(F.zip_with(hidden, F.slice(out, 2, F.size(hidden)), lambda a, b: a * b))
    return out[0] + through + F.when(F.size(straight) > 0, total(F.zip_with(x, straight, lambda a, b: a * b))).otherwise(F.lit(0.0))


def predict(table: DataFrame, models: DataFrame, group: str, x: list[str] | str, how: str = "median") -> DataFrame:
    """table with yhat, and yhat_members by rep; null where an input is null or the group has no model.

    Weights are counted first: few are sent to every task, which scores its rows with numpy; many are joined to the rows by
    group and scored by expressions.
    """
    joined = scored_here(table, models, group, x) if count_weights(models) <= SMALL else scored_by_join(table, models, group, x)
    return joined.withColumn("yhat", F.when(F.size("yhat_members") > 0, combined(F.col("yhat_members"), how)))


def combined(v: Column, how: str) -> Column:
    """The mean, median or density mode of an array."""
    if how == "mode":
        return pandas_udf(row_modes, "double")(v)
    if how == "mean":
        return A.mean(v)
    n = F.size(v)
    return A.let(F.sort_array(v), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def row_modes(v: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or not len(a) else density_mode(a) for a in v], dtype=float)


def count_weights(models: DataFrame) -> int:
    each = F.aggregate("members", F.lit(0).cast("long"), lambda s, m: s + F.size(m["w_in"]) * F.size(m["w_out"]) + F.size(m["direct"]))
    return models.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def scored_here(table: DataFrame, models: DataFrame, group: str, x: list[str] | str) -> DataFrame:
    """table with yhat_members, scored with models that were counted and are small."""
    held = {r.g: ([([np.array(m.w_in, float).reshape(len(m.w_in), len(m.w_in[0])), np.array(m.w_out, float)[:, None]], np.array(m.direct, float)) for m in r.members], np.array(r.low), np.array(r.high), r.link) for r in models.collect()}

    whole = isinstance(x, str)

    def score(g: pd.Series, *columns: pd.Series) -> pd.Series:
        out = [None] * len(g)
        if whole:
            p = max((len(high) for _, _, high, _ in held.values()), default=1) - 1
            v = np.array([np.full(p, np.nan) if r is None or len(r) != p else r for r in columns[0]], float).reshape(len(g), p)
        else:
            v = np.column_stack([c.to_numpy(float) for c in columns])
        for name, at in g.groupby(g).groups.items():
            if name not in held:
                continue
            members, low, high, link = held[name]
            part = v[at]
            wide = np.where(high > low, high - low, 1.0)
            z = np.where(high[1:] > low[1:], 2 * (part - low[1:]) / wide[1:] - 1, 0.0 * part)
            y = np.column_stack([nets.forward(z, layers, direct, "softsign") for layers, direct in members])
            y = ((np.tanh(y / 2) if link == "logistic" else y) + 1) / 2 * (high[0] - low[0]) + low[0]
            for i, row, good in zip(at, y, np.isfinite(part).all(1), strict=True):
                out[i] = row.tolist() if good else None
        return pd.Series(out, dtype=object)

    return table.withColumn("yhat_members", pandas_udf(score, "array<double>")(F.col(group).cast("string"), *([as_array(x)] if whole else [F.col(c).cast("double") for c in x])))


def scored_by_join(table: DataFrame, models: DataFrame, group: str, x: list[str] | str) -> DataFrame:
    """table with yhat_members, by one join on the group and expressions on each row."""
    names = {c: f"__{c}" for c in ("g", "members", "low", "high", "link")}
    joined = table.join(models.select(*(F.col(c).alias(n) for c, n in names.items())), F.col(group).cast("string") == F.col("__g"), "left")
    inputs = F.transform(as_array(x), lambda v, i: to_range(v, F.get("__low", i + 1), F.get("__high", i + 1)))
    joined = joined.withColumn("__x", F.when(F.size(as_array(x)) == F.size("__low") - 1, inputs))
    low, high = F.col("__low")[0], F.col("__high")[0]
    linked = lambda v: F.when(F.col("__link") == "logistic", F.tanh(v / 2)).otherwise(v)
    joined = joined.withColumn("yhat_members", F.when(F.col("__x").isNotNull(), F.transform("__members", lambda m: (linked(output(F.col("__x"), m)) + 1) / 2 * (high - low) + low)))
    return joined.drop("__x", *names.values())
