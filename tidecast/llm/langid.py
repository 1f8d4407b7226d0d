"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in both directions, labels every byte position, and the document's probability is the
mean over all its positions. The recurrence runs over stretches of up to STRETCH bytes, cut between characters, and CONTEXT bytes
more on either side, whose positions count in the neighbouring stretch; so each position is labelled once, with what stands
before and after it in view, and a text of any length takes bounded memory. Training is done in numpy by backpropagation through
time, on stretches from a bounded sample of labelled rows (TRAIN_DOCS for each language).

Null text or one without a letter (Unicode category L): `und` with score 0. Where there is nothing to learn from, every row is
`und`. Repeated rows give repeated results; of the other columns only lang is read, and only for training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import slices, table

#: Rows of each language that training may use, at most and on average; longer texts than TRAIN_CHARS are not drawn.
TRAIN_DOCS, TRAIN_CHARS = 300, 20_000
STRETCH, CONTEXT, HIDDEN, EMBED = 512, 32, 12, 16
#: Bytes of the stretches that training reads, and rows that a worker runs at once.
TRAIN_BYTES, ROWS = 80, 1024
LETTER = regex.compile(r"\p{L}")
END = 256


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Embedding -> gated recurrent units in both directions -> softmax at every position."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng, self.classes = np.random.default_rng(seed), classes
        self.p = {"embed": rng.normal(0, 0.3, (257, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, len(classes))), "bias": np.zeros(len(classes))}
        for way in "fb":
            self.p[f"in_{way}"] = rng.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN))
            self.p[f"rec_{way}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
            self.p[f"b_{way}"] = np.zeros(3 * HIDDEN)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of x (byte values, END after the end) with labels y (one a row), and its gradients."""
        p, h_, (rows, steps), kind = self.p, HIDDEN, x.shape, self.p["out"].dtype
        real = (x != END)[..., None].astype(kind)
        states, traces = np.zeros((rows, steps, 2 * h_), kind), []
        for k, way in enumerate("fb"):
            drive = (p["embed"] @ p[f"in_{way}"] + p[f"b_{way}"])[x]
            h, trace = np.zeros((rows, h_), kind), []
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                a, g = drive[:, t], h @ p[f"rec_{way}"]
                gates = sigmoid(a[:, : 2 * h_] + g[:, : 2 * h_])
                z, r = gates[:, :h_], gates[:, h_:]
                n = np.tanh(a[:, 2 * h_ :] + r * g[:, 2 * h_ :])
                trace.append((t, h, z, r, n, g[:, 2 * h_ :]))
                h = h + real[:, t] * z * (n - h)
                states[:, t, k * h_ : (k + 1) * h_] = h
            traces.append(trace)
        logits = states @ p["out"] + p["bias"]
        e = np.exp(logits - logits.max(-1, keepdims=True))
        prob = e / e.sum(-1, keepdims=True)
        count, label = real.sum(), y[:, None, None].repeat(steps, 1)
        own = np.take_along_axis(prob, label, 2)
        loss = float(-(np.log(own + 1e-12) * real).sum() / count)
        np.put_along_axis(prob, label, own - 1, 2)
        d = prob * (real / count)
        g, flat = {k: np.zeros_like(v) for k, v in p.items()}, d.reshape(-1, d.shape[-1])
        g["out"], g["bias"] = states.reshape(-1, 2 * h_).T @ flat, flat.sum(0)
        d_states = d @ p["out"].T
        for k, (way, trace) in enumerate(zip("fb", traces, strict=True)):
            rec, d_drive, dh = p[f"rec_{way}"], np.zeros((rows, steps, 3 * h_), kind), np.zeros((rows, h_), kind)
            for t, h, z, r, n, g_n in reversed(trace):
                dh = dh + d_states[:, t, k * h_ : (k + 1) * h_]
                m = real[:, t]
                dz, dn = dh * m * (n - h) * z * (1 - z), dh * m * z * (1 - n * n)
                dr = dn * g_n * r * (1 - r)
                d_drive[:, t] = np.concatenate([dz, dr, dn], 1)
                d_g = np.concatenate([dz, dr, dn * r], 1)
                g[f"rec_{way}"] += h.T @ d_g
                dh = dh * (1 - m * z) + d_g @ rec.T
            flat = d_drive.reshape(-1, 3 * h_)
            g[f"b_{way}"] += flat.sum(0)
            by_byte = np.zeros((257, 3 * h_), kind)
            np.add.at(by_byte, x.ravel(), flat)
            g[f"in_{way}"] += p["embed"].T @ by_byte
            g["embed"] += by_byte @ p[f"in_{way}"].T
        return loss, g

    def train(self, stretches: list[bytes], labels: np.ndarray, steps: int = 300, batch: int = 160, rate: float = 0.012, seed: int = 5) -> "Network":
        """Adam over batches of stretches, with as many of each class as chance gives from classes drawn evenly."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        by_class = [x for x in by_class if len(x)]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            drawn = np.concatenate([rng.choice(x, batch // len(by_class) + 1) for x in by_class])
            _, g = self.gradients(pad([stretches[i] for i in drawn]), labels[drawn])
            norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
            lr = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, x in self.p.items():
                own = g[k] * min(1.0, 1.0 / (norm + 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * own
                v[k] = 0.99 * v[k] + 0.01 * own**2
                x -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def ready(self) -> "Reader":
        return Reader(self)


class Reader:
    """A network set up to label stretches: tables from byte to what it adds to each gate and to the new state, by direction."""

    def __init__(self, net: Network):
        self.classes, h_ = net.classes, HIDDEN
        self.ways = []
        for k, w in enumerate("fb"):
            table, rec = net.p["embed"] @ net.p[f"in_{w}"] + net.p[f"b_{w}"], net.p[f"rec_{w}"]
            # sigmoid(x) is (tanh(x / 2) + 1) / 2
            parts = [(np.ascontiguousarray(table[:, i * h_ : (i + 1) * h_] * f), np.ascontiguousarray(rec[:, i * h_ : (i + 1) * h_] * f)) for i, f in enumerate((np.float32(0.5), np.float32(0.5), np.float32(1)))]
            self.ways.append((parts, np.ascontiguousarray(net.p["out"][k * h_ : (k + 1) * h_])))
        self.bias = net.p["bias"]

    def probabilities(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(classes, positions, rows) for x (positions, rows), whose columns have `sizes` bytes and are in descending order of these."""
        active = np.searchsorted(-sizes, -np.arange(len(x)), "left")
        logits = np.zeros((len(self.classes), *x.shape), np.float32) + self.bias[:, None, None]
        for k, (((t_z, r_z), (t_r, r_r), (t_n, r_n)), out) in enumerate(self.ways):
            h = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in range(len(x)) if k == 0 else range(len(x) - 1, -1, -1):
                n = active[t]
                own, at = h[:n], x[t, :n]
                z, r, new = own @ r_z, own @ r_r, own @ r_n
                z += t_z.take(at, 0)
                r += t_r.take(at, 0)
                np.tanh(z, z)
                np.tanh(r, r)
                z *= 0.5
                z += 0.5
                r *= 0.5
                r += 0.5
                new *= r
                new += t_n.take(at, 0)
                np.tanh(new, new)
                new -= own
                new *= z
                own += new
                logits[:, t, :n] += (own @ out).T
        logits -= logits.max(0)
        np.exp(logits, logits)
        logits /= logits.sum(0)
        return logits

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its mean probability for each text, to five places: later ones depend on the texts beside it."""
        rows = [(i, *s) for i, text in enumerate(texts) if text and LETTER.search(text) for s in stretches_of(text.encode("utf-8", "surrogatepass"))]
        rows.sort(key=lambda r: -len(r[1]))
        sums = np.zeros((len(texts), len(self.classes) + 1))
        for k in range(0, len(rows), ROWS):
            own = rows[k : k + ROWS]
            x, sizes = pad([r[1] for r in own]).T.copy(), np.array([len(r[1]) for r in own])
            doc, low, high = (np.array([r[j] for r in own]) for j in (0, 2, 3))
            at = np.arange(len(x))[:, None]
            counted = (at >= low) & (at < high)
            prob = np.einsum("ctr,tr->rc", self.probabilities(x, sizes), counted.astype(np.float32))
            np.add.at(sums, doc, np.concatenate([prob, counted.sum(0)[:, None]], 1))
        found = []
        for own in sums:
            mean = own[:-1] / own[-1] if own[-1] else None
            best = 0 if mean is None else int(mean.argmax())
            found.append(("und", 0.0) if mean is None else (self.classes[best], round(float(min(1.0, max(0.0, mean[best]))), 5)))
        return found


def pad(stretches: list[bytes]) -> np.ndarray:
    x = np.full((len(stretches), max(map(len, stretches), default=1)), END, np.int64)
    for row, raw in zip(x, stretches, strict=True):
        row[: len(raw)] = np.frombuffer(raw, np.uint8)
    return x


def cut_at(raw: bytes, at: int) -> int:
    """The last place up to `at` where a character begins, or the end."""
    at = min(at, len(raw))
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def stretches_of(raw: bytes, size: int = STRETCH, context: int = CONTEXT) -> Iterator[tuple[bytes, int, int]]:
    """Stretches of raw with their context, and the positions in them that count."""
    low = 0
    while low < len(raw):
        high = cut_at(raw, low + size)
        begin = cut_at(raw, max(0, low - context))
        yield raw[begin : cut_at(raw, high + context)], low - begin, high - begin
        low = high


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Network | None:
    """Network from about train_docs rows a language (those of least hash), out of rows whose crc32(id as text) mod 4 is not 2."""
    known = docs.where(f"`{lang_col}` is not null and `{text_col}` is not null and `{id_col}` is not null").where((F.crc32(F.col(id_col).cast("string").cast("binary")) % 4) != 2)
    known = known.where(F.length(text_col) <= TRAIN_CHARS)
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(train_docs / n)) for k, n in counts.items()])
    rows = known.where(F.pmod(F.xxhash64(F.lit(3), id_col), F.lit(1 << 20)) / F.lit(float(1 << 20)) < share).select(id_col, text_col, lang_col).limit(2 * train_docs * len(counts)).collect()
    classes = sorted(counts)
    stretches, labels = [], []
    for _, text, lang in sorted(rows):
        own = [x for x, _, _ in stretches_of(text.encode("utf-8", "surrogatepass"), TRAIN_BYTES, 0)]
        stretches += own
        labels += [classes.index(lang)] * len(own)
    if not stretches:
        return None
    return Network(classes).train(stretches, np.array(labels))


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the language and its score added; a column that has the name of one of them is an error."""
    if (clash := {c.lower() for c in docs.columns} & {pred_col.lower(), score_col.lower()}):
        raise ValueError(f"docs have columns of these names: {', '.join(sorted(clash))}")
    if net is None:
        return docs.withColumns({pred_col: F.lit("und"), score_col: F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(net)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value.ready()
        for batch in slices(batches, 200):
            found = scorer.score(batch.column(where).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*batch.schema.names, pred_col, score_col])

    return docs.mapInArrow(run, f"{fields}, `{pred_col}` string, `{score_col}` double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.select("doc_id", "text", "lang"))
    held_out = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2, F.lit(False))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
