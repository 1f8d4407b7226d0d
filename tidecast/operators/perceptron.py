"""Perceptrons for tables of any length, by group: full-batch resilient propagation whose slopes every task sums over its own rows.

A step is one pass over the scaled table, which is written once by blocks of groups: a task adds up the slopes of all its rows before it
gives any, the sums of a member meet as a stream of short pieces, and the driver moves the weights of a block's members, which number
SMALL on average whatever the table's length. Weights are written every SAVED steps, so a run that was broken off goes on from them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import arrays as A
from tidecast.functions import nets
from tidecast.operators.regression import PIECE, SMALL, as_array, by_blocks, combined, scaled_rows, to_range
from tidecast.sources.written import discard, materialise

SAVED = 50
WEIGHTS = "g string, rep int, layers array<array<array<double>>>, settled boolean, steps int, mse double"


def fit(table: DataFrame, group: str, y: str, x: list[str] | str, hidden: tuple[int, ...] = (5,), reps: int = 20, steps: int = 2000, threshold: float = 0.01, seed: int = 42, start: DataFrame | None = None) -> DataFrame:
    """(g, low, high, members) for each group, written to the shared folder: the members' layers, whether they settled, steps and error.

    y and x are as in regression.fit and are scaled to between -1 and 1. A member ends when no slope of half its squared
    error is as large as threshold; after `steps` steps it gives its best layers so far and settled false. start: members
    (g, rep, layers) to go on from, as saved() reads them.
    """
    ready, ends, p = scaled_rows(table, group, y, x)
    weights = sum((a + 1) * b for a, b in zip((p, *hidden), (*hidden, 1), strict=True))
    blocks = max(1, -(-ends.count() * reps * weights // SMALL))
    written, own = by_blocks(ready, blocks)
    each = [materialise(settle(some, p, hidden, reps, steps, threshold, seed, start), "weights") for some in own]
    found = each[0]
    for more in each[1:]:
        found = found.unionByName(more)
    members = found.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("rep", "layers", "settled", "steps", "mse"))).alias("members"))
    out = materialise(members.join(ends.drop("n"), "g"), "models")
    discard(written, ends, *each)
    return out


def settle(rows: DataFrame, p: int, hidden: tuple[int, ...], reps: int, steps: int, threshold: float, seed: int, start: DataFrame | None) -> DataFrame:
    """Rows of WEIGHTS for the members of one block."""
    spark, groups = rows.sparkSession, {r.g: r.n for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = {(r.g, r.rep): [np.array([list(w) for w in a], float) for a in r.layers] for r in start.collect() if r.g in groups} if start is not None else {}
    held = {(g, rep): nets.Propagation(p, hidden, np.random.default_rng([seed, zlib.crc32(g.encode()), rep]), before.get((g, rep))) for g in groups for rep in range(reps)}
    taken, saved = dict.fromkeys(held, 0), None

    def state() -> DataFrame:
        out = [(g, rep, [a.tolist() for a in m.best], m.settled, taken[g, rep], m.least / groups[g]) for (g, rep), m in held.items()]
        return spark.createDataFrame(out, WEIGHTS)

    for k in range(steps):
        moving = {at: m.w for at, m in held.items() if not m.settled}
        if not moving:
            break
        sent = spark.sparkContext.broadcast(moving)
        for at, flat in summed(rows, sent, p).items():
            m, parts, begin = held[at], [], 1
            for a in m.w:
                parts.append(flat[begin : begin + a.size].reshape(a.shape))
                begin += a.size
            m.update(float(flat[0]), parts, threshold)
            taken[at] = k + 1
        sent.destroy()
        if k % SAVED == SAVED - 1:
            saved, old = materialise(state(), "perceptrons"), saved
            if old is not None:
                discard(old)
    out = state()
    if saved is not None:
        discard(saved)
    return out


def summed(rows: DataFrame, sent, p: int) -> dict[tuple[str, int], np.ndarray]:
    """Squared error and slopes, one after the other, of each member that still moves, over all rows of its group."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        by_group: dict[str, list] = {}
        for (g, rep), w in sent.value.items():
            by_group.setdefault(g, []).append((rep, w))
        for batch in batches:
            codes, found = pd.factorize(batch.column("g").to_pandas())
            x, y = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, p), batch.column("y").to_numpy()
            for k, g in enumerate(found):
                for rep, w in by_group.get(g, ()):
                    sse, own = nets.slopes(x[codes == k], y[codes == k], w)
                    flat = np.concatenate([[sse], *(a.ravel() for a in own)])
                    held[g, rep] = held[g, rep] + flat if (g, rep) in held else flat
        for (g, rep), flat in held.items():
            cuts = np.arange(0, len(flat), PIECE, dtype=np.int32)
            same = [pa.array([v] * len(cuts), kind) for v, kind in ((g, pa.string()), (rep, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(cuts // PIECE), pa.ListArray.from_arrays(np.append(cuts, np.int32(len(flat))), pa.array(flat))], names=["g", "rep", "piece", "m"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, at in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "rep", "piece")), strict=True)):
                held[at] = held.get(at, 0.0) + batch.column("m")[k].values.to_numpy()
        for (g, rep, piece), flat in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([rep], pa.int32()), pa.array([piece], pa.int32()), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["g", "rep", "piece", "m"])

    schema = "g string, rep int, piece int, m array<double>"
    parts: dict[tuple[str, int], dict[int, list]] = {}
    for r in rows.select("g", "y", "x").mapInArrow(part, schema).repartition("g", "rep", "piece").mapInArrow(total, schema).collect():  # as many numbers as the block has weights
        parts.setdefault((r.g, r.rep), {})[r.piece] = r.m
    return {at: np.concatenate([own[k] for k in sorted(own)]) for at, own in parts.items()}


def saved(models: DataFrame) -> DataFrame:
    """(g, rep, layers) of fitted models, to go on from."""
    return models.select("g", F.explode("members").alias("m")).select("g", "m.rep", "m.layers")


def predict(table: DataFrame, models: DataFrame, group: str, x: list[str] | str, how: str = "median") -> DataFrame:
    """table with yhat and yhat_members by rep, joined by group and scored by expressions; null where an input is null or there is no model."""
    names = {c: f"__{c}" for c in ("g", "members", "low", "high")}
    joined = table.join(models.select(*(F.col(c).alias(n) for c, n in names.items())), F.col(group).cast("string") == F.col("__g"), "left")
    ranged = F.transform(as_array(x), lambda v, i: to_range(v, F.get("__low", i + 1), F.get("__high", i + 1)))
    member = lambda m: F.struct(m["layers"].alias("layers"), A.none().alias("direct"), F.lit("logistic").alias("activation"))
    low, high = F.get("__low", F.lit(0)), F.get("__high", F.lit(0))
    each = A.let(F.when(F.size(as_array(x)) == F.size("__low") - 1, ranged), lambda v: F.when(v.isNotNull(), F.transform("__members", lambda m: (A.network(v, member(m)) + 1) / 2 * (high - low) + low)))
    out = joined.withColumn("yhat_members", each)
    return out.withColumn("yhat", F.when(F.size("yhat_members") > 0, combined(F.col("yhat_members"), how))).drop(*names.values())
