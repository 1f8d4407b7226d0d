"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

A word is a run of letters, digits and bytes past ASCII, or a run of other marks, as it is written. Words fall into 2**BITS buckets
by hash. Each bucket has a sparse random index vector; its context vector is the sum of the index vectors of the words up to SPAN
places away, over all texts of the corpus, so the table's size is fixed however many words there are. A document's vector is the mean
over its words of their context vectors, scaled to length 1 less what all words have in common, and of their index vectors, and
the mean product of a word's vectors with those of the word 1 to SPAN places on, which is large where words repeat.

The network is trained in numpy on a bounded sample of labelled rows (TRAIN_ROWS, those of least hash), a part of which is
kept back to fit the temperature that divides its output. Scores go to five places, as sums may differ beyond.

Null text counts as empty; a text without a word has a vector of zeros and the score the network gives that. Texts are read in pieces
of PIECE bytes, cut after a white space where there is one; a context ends at a cut. Where no label is known, or none but one,
every score is the share of label 1 with one more row of each. Rows that repeat a doc_id are rows of their own. Labels other than 0 and 1 are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import discard, materialise, slices, table

BITS, DIM, NONZERO, SPAN = 15, 32, 4, 2
#: Labelled rows that training may use, on average; bytes of a piece of text, and of texts looked at together.
TRAIN_ROWS, PIECE, TOGETHER = 20_000, 1 << 20, 1 << 20
#: Buckets of a row of counts on its way to the sum.
ROW = 256
MULTIPLIER = 0x9E3779B97F4A7C15
KIND = np.full(256, 2, np.uint8)
KIND[list(range(33)) + [127]] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class Words:
    """Splits bytes into words and gives each one's bucket: a polynomial hash of its bytes, by differences of running sums."""

    def __init__(self):
        self.power, self.inverse = (self.powers(x, 1) for x in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))

    @staticmethod
    def powers(x: int, n: int) -> np.ndarray:
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x, np.uint64)])

    def of(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, bucket) of each word, in order."""
        if len(raw) >= len(self.power):
            self.power, self.inverse = (self.powers(x, 2 * len(raw)) for x in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
        kind = KIND[raw]
        turn = np.flatnonzero(np.r_[len(raw) > 0, kind[1:] != kind[:-1], True])
        begin, end = turn[:-1], turn[1:]
        word = kind[begin] > 0
        begin, end = begin[word], end[word]
        total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], dtype=np.uint64)]
        code = (total[end] - total[begin]) * self.inverse[begin]
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return begin, (code >> np.uint64(64 - BITS)).astype(np.int64)


def pieces(text: str | None) -> Iterator[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        if end < len(raw):
            blank = max(raw.rfind(c, at, end) for c in (b" ", b"\n"))
            end = blank + 1 if blank > at else end
        yield raw[at:end]
        at = end


def bundles(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of texts, about TOGETHER bytes at once: (bytes, first byte of each piece, its text). A zero byte ends each piece."""
    held, docs, size = [], [], 0
    for i, text in enumerate(texts):
        for raw in pieces(text):
            held.append(raw)
            docs.append(i)
            size += len(raw) + 1
            if size >= TOGETHER:
                yield joined(held, docs)
                held, docs, size = [], [], 0
    if held:
        yield joined(held, docs)


def joined(held: list[bytes], docs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.r_[0, np.cumsum([len(r) + 1 for r in held])[:-1]]
    return np.frombuffer(b"\0".join(held) + b"\0", np.uint8), starts, np.array(docs)


def index_vectors(seed: int = 1) -> np.ndarray:
    """(bucket, DIM) of -1, 0 and 1, NONZERO of them not 0."""
    rng, out = np.random.default_rng(seed), np.zeros((1 << BITS, DIM), np.int8)
    at = rng.random((1 << BITS, DIM)).argsort(1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), at.shape), 1)
    return out


class Contexts:
    """Counts of what stands beside each bucket's words: sums of index vectors."""

    def __init__(self):
        index = index_vectors()
        self.at = np.argsort(index == 0, 1, kind="stable")[:, :NONZERO]
        self.sign = np.take_along_axis(index, self.at, 1).astype(np.float64)
        self.sums, self.words = np.zeros((1 << BITS) * DIM, np.int64), Words()

    def add(self, texts: list[str | None]) -> None:
        for raw, starts, _ in bundles(texts):
            begin, bucket = self.words.of(raw)
            piece = np.searchsorted(starts, begin, "right")
            own, beside = [], []
            for k in range(1, SPAN + 1):
                same = piece[k:] == piece[:-k]
                left, right = bucket[:-k][same], bucket[k:][same]
                own += [left, right]
                beside += [right, left]
            if own:
                own, beside = np.concatenate(own), np.concatenate(beside)
                # equal pairs once, with their count
                pair, count = np.unique(own << BITS | beside, return_counts=True)
                own, beside = pair >> BITS, pair & ((1 << BITS) - 1)
                for j in range(NONZERO):
                    np.add.at(self.sums, own * DIM + self.at[beside, j], (count * self.sign[beside, j]).astype(np.int64))


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(bucket, DIM) sums of index vectors over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Contexts()
        for batch in batches:
            for own in slices(pa.Table.from_batches([batch]).to_batches(), 200):
                found.add(own.column(0).to_pylist())
        sums = found.sums.reshape(-1, ROW * DIM)
        yield from rows_of(enumerate(sums))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        yield from rows_of(held.items())

    def rows_of(rows) -> Iterator[pa.RecordBatch]:
        for k, own in rows:
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "sums"])

    parts = (1 << BITS) // ROW
    # a part's rows are added one by one as they come, however many tasks have counted; as many rows as the table has parts return
    summed = docs.select(text_col).mapInArrow(count, "part int, sums binary").repartition(parts, "part").mapInArrow(add, "part int, sums binary")
    out = np.zeros((parts, ROW * DIM), np.int64)
    for part, raw in summed.collect():
        out[part] = np.frombuffer(raw, np.int64)
    return out.reshape(-1, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """(bucket, 2 * DIM) float32: the context vector at length 1 less the mean of all that are known, and the index vector."""
    length = np.sqrt((sums.astype(float) ** 2).sum(1, keepdims=True))
    unit = sums / np.maximum(length, 1)
    known = length[:, 0] > 0
    unit[known] -= unit[known].mean(0) if known.any() else 0
    return np.hstack([unit, index_vectors() / NONZERO**0.5]).astype(np.float32)


class Pool:
    def __init__(self, vectors: np.ndarray):
        self.vectors, self.words = vectors, Words()

    def of(self, texts: list[str | None]) -> np.ndarray:
        """A mean vector for each text: of its words, then of the products of neighbours, by distance."""
        sums, counts = np.zeros((len(texts), self.vectors.shape[1] + 2 * SPAN)), np.zeros(len(texts))
        for raw, starts, docs in bundles(texts):
            begin, bucket = self.words.of(raw)
            if not len(begin):
                continue
            piece = np.searchsorted(starts, begin, "right") - 1
            edge = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            own = self.vectors[bucket]
            beside = np.zeros((len(own), 2, SPAN), np.float32)
            for k in range(1, min(SPAN, len(own) - 1) + 1):
                same = piece[k:] == piece[:-k]
                beside[k:, :, k - 1] = np.einsum("ijk,ijk->ij", own[k:].reshape(-1, 2, DIM), own[:-k].reshape(-1, 2, DIM)) * same[:, None]
            own = np.hstack([own, beside.reshape(len(own), -1)])
            np.add.at(sums, docs[piece[edge]], np.add.reduceat(own, edge, 0))
            np.add.at(counts, docs[piece[edge]], np.diff(np.r_[edge, len(begin)]))
        return sums / np.maximum(counts, 1)[:, None]


def pooled(docs: DataFrame, vectors: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs without their text, with a column pool array<float>."""
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    others = [f for f in docs.schema if f.name != text_col]
    where, kept = docs.columns.index(text_col), [(docs.columns.index(f.name), f.name) for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(held.value)
        for batch in slices(batches, 200):
            found = pool.of(batch.column(where).to_pylist()).astype(np.float32)
            flat = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k, _ in kept), flat], names=[*(name for _, name in kept), "pool"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "pool array<float>"]))


class Scorer:
    """tanh layer, then one logistic output, trained by Adam; inputs are standardised; temperature divides the output."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 16, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        order = rng.permutation(len(y))
        kept, back = order[len(y) // 5 :], order[: len(y) // 5]
        z = (x - self.mean) / self.sd
        self.p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        self.temperature = 1.0
        for epoch in range(epochs):
            for own in np.array_split(rng.permutation(kept), max(1, len(kept) // batch)):
                t += 1
                grads = self.gradients(z[own], y[own])
                lr = rate * (1 - epoch / epochs)
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] * (1 - decay * lr * (k % 2 == 0)) - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        if len(back):
            self.temperature = calibrated(self.logits(x[back]), y[back])

    def gradients(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, u, c = self.p
        h = np.tanh(z @ w + b)
        d = (1 / (1 + np.exp(-np.clip(h @ u + c, -50, 50))) - y) / len(y)
        back = np.outer(d, u) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ d, np.array([d.sum()])]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.p
        return np.tanh((x - self.mean) / self.sd @ w + b) @ u + c

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50))), 5)


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, from a fine grid between 0.1 and 10."""
    grid = np.geomspace(0.1, 10, 200)
    z = logits / grid[:, None]
    return float(grid[(np.logaddexp(0, z) - y * z).mean(1).argmin()])


def fit(pools: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Scorer | float:
    """Scorer from pools(id, pool) and labels(id, label), or the share of label 1 where there is nothing to tell apart."""
    known = labels.where(f"`{id_col}` is not null and `{label_col}` in (0, 1)").where((F.crc32(F.col(id_col).cast("string").cast("binary")) % 5) != 0).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return (counts.get(1.0, 0) + 1) / (sum(counts.values()) + 2)
    share = train_rows / sum(counts.values())
    some = known.where(F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < share)
    # labels of one id may be many, its documents too: a bound on either side of the join and on what comes back
    rows = some.limit(2 * train_rows).join(pools, F.col("_id") == F.col(id_col)).select("_id", "_label", "pool").limit(2 * train_rows).collect()
    if len({r[1] for r in rows}) < 2:
        return (counts[1.0] + 1) / (sum(counts.values()) + 2)
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    return Scorer(np.array([r[2] for r in rows], float), np.array([r[1] for r in rows]))


def scored(pools: DataFrame, scorer: Scorer | float, score_col: str = "score") -> DataFrame:
    """pools with the score instead of the pooled vector."""
    if isinstance(scorer, float):
        return pools.drop("pool").withColumn(score_col, F.lit(round(scorer, 5)))
    held = pools.sparkSession.sparkContext.broadcast(scorer)
    others = [f for f in pools.schema if f.name != "pool"]
    kept = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("pool").flatten().to_numpy().reshape(batch.num_rows, -1).astype(float) if batch.num_rows else np.zeros((0, len(held.value.mean)))
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), pa.array(held.value.score(x))], names=[*kept, score_col])

    return pools.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{score_col}` double"]))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pools = materialise(pooled(docs, word_vectors(context_vectors(docs))), "pools")
    scores = materialise(scored(pools, fit(pools, table(spark, sf_dir, "labels"))), "scores")
    discard(pools)
    held_out = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
