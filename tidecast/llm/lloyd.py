"""Vector code compression: product codes by Lloyd rounds that rescan only parts whose assignment may have changed.

Heap Lloyd: a scan of a part leaves the distance to its own entry (upper) and to the next (lower). When entries move, lower - upper
shrinks by no more than the own entry's drift and the largest drift of any other. So each entry has a heap of its parts, keyed by
their slack plus the drift that the entry had cumulated when the part was put there; a round pops the parts whose key the cumulated
drift has reached, rescans those exactly and pushes them again. All others keep their entry, provably.

The heaps are local to a block of vectors, a row of a table in the shared folder: the vectors, and by part the order of the heap and
the keys. A heap is an ascending run, so what is violated is a prefix. A round reads one such table and writes the next, after which
the first goes; the sums of each entry are kept up to date by what has moved, and only they, their size fixed by the codebooks, come
to the driver. Everything is in whole numbers but the bounds, which are widened by more than rounding can miss.

Vectors that are null or hold null or non-finite components are left out. Vectors of another length than most (of equally many,
the longer) have a null code and error and train nothing. Rows with one vec_id are vectors of their own; a null vec_id comes last.
With fewer vectors than entries there are as many entries as vectors. An empty table gives no rows. Other columns don't matter.
Components must stay under 2**27 once scaled, and their number must be a multiple of the parts: anything else is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import discard, join_spread, materialise, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block at most.
BLOCK = 4096
STATE = "ids array<bigint>, labels array<bigint>, points binary, own binary, heaps binary, keys binary, sums array<bigint>, counts array<bigint>, scanned bigint"
CODES = "vec_id bigint, label bigint, code string, error bigint"


class Books:
    """Codebooks (parts, entries, width) in whole numbers, and the drift each entry has cumulated."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.drift = entries, np.zeros(entries.shape[:2])

    def moved_to(self, new: np.ndarray) -> "Books":
        moved = np.sqrt(((new - self.entries).astype(float) ** 2).sum(2)) * (1 + 1e-12)
        out = Books(new)
        for p, own in enumerate(moved):
            top = np.sort(np.append(own, 0.0))[::-1]
            others = np.where(own == top[0], np.where((own == top[0]).sum() > 1, top[0], top[1]), top[0])
            out.drift[p] = self.drift[p] + own + others
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def scan(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, the lower index at ties; slack: least distance to another entry minus that to the nearest) of points."""
    d = np.stack([((points - e) ** 2).sum(1) for e in entries], 1)
    own = d.argmin(1)
    at = np.arange(len(points))
    upper = np.sqrt(d[at, own].astype(float))
    if len(entries) == 1:
        return own, np.full(len(points), np.inf)
    d[at, own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(float))
    return own, lower - upper - 1e-12 * (lower + upper)


class Block:
    """Vectors and their heaps. own[p][i]: the entry of part p of vector i; heaps[p]: the vectors by entry, then by key."""

    def __init__(self, ids: pa.Array, labels: pa.Array, points: np.ndarray, books: Books):
        parts, entries, width = books.entries.shape
        self.ids, self.labels, self.points = ids, labels, points
        self.own, self.keys = np.zeros((parts, len(points)), np.uint8), np.zeros((parts, len(points)))
        self.heaps = np.zeros((parts, len(points)), np.int32)
        self.sums, self.counts, self.scanned = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), 0
        for p in range(parts):
            self.own[p], slack = scan(self.part(p, slice(None)), books.entries[p])
            self.keys[p] = slack + books.drift[p][self.own[p]]
            self.heaps[p] = np.lexsort((self.keys[p], self.own[p]))
            np.add.at(self.sums[p], self.own[p], self.part(p, slice(None)))
            self.counts[p] = np.bincount(self.own[p], minlength=entries)

    def part(self, p: int, rows) -> np.ndarray:
        width = self.sums.shape[2]
        return self.points[rows, p * width : (p + 1) * width].astype(np.int64)

    def reassign(self, books: Books) -> None:
        """Pops what the drift has reached, rescans it and pushes it again."""
        self.scanned = 0
        for p, entries in enumerate(books.entries):
            own, keys, heap = self.own[p], self.keys[p], self.heaps[p]
            ends = np.searchsorted(own[heap], np.arange(len(entries) + 1))
            runs = [heap[a:b] for a, b in zip(ends, ends[1:])]
            cut = [np.searchsorted(keys[run], books.drift[p, e], "right") for e, run in enumerate(runs)]
            popped = np.concatenate([run[:k] for run, k in zip(runs, cut, strict=True)])
            if not len(popped):
                continue
            self.scanned += len(popped)
            before, x = own[popped].copy(), self.part(p, popped)
            own[popped], slack = scan(x, entries)
            keys[popped] = slack + books.drift[p][own[popped]]
            gone = own[popped] != before
            np.subtract.at(self.sums[p], before[gone], x[gone])
            np.add.at(self.sums[p], own[popped][gone], x[gone])
            self.counts[p] += np.bincount(own[popped][gone], minlength=len(entries)) - np.bincount(before[gone], minlength=len(entries))
            fresh = popped[np.lexsort((keys[popped], own[popped]))]
            into = np.searchsorted(own[fresh], np.arange(len(entries) + 1))
            merged = []
            for e, (run, k) in enumerate(zip(runs, cut, strict=True)):
                rest, new = run[k:], fresh[into[e] : into[e + 1]]
                merged.append(np.insert(rest, np.searchsorted(keys[rest], keys[new]), new))
            self.heaps[p] = np.concatenate(merged)

    def errors(self, books: Books) -> np.ndarray:
        return sum(((self.part(p, slice(None)) - books.entries[p][self.own[p]]) ** 2).sum(1) for p in range(len(self.own)))

    def row(self) -> pa.RecordBatch:
        held = [self.points.tobytes(), self.own.tobytes(), self.heaps.tobytes(), self.keys.tobytes()]
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        columns = [one(self.ids), one(self.labels), *(pa.array([b], pa.binary()) for b in held), one(pa.array(self.sums.ravel())), one(pa.array(self.counts.ravel())), pa.array([self.scanned], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in STATE.split(", ")])

    @staticmethod
    def of(batch: pa.RecordBatch, k: int, shape: tuple[int, int, int]) -> "Block":
        b, (parts, entries, width) = Block.__new__(Block), shape
        flat = lambda name: batch.column(name).slice(k, 1).flatten()
        raw = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind).copy()
        b.ids, b.labels = flat("ids"), flat("labels")
        b.points = raw("points", np.int32).reshape(len(b.ids), parts * width)
        b.own, b.heaps, b.keys = (raw(name, kind).reshape(parts, -1) for name, kind in (("own", np.uint8), ("heaps", np.int32), ("keys", np.float64)))
        b.sums, b.counts = flat("sums").to_numpy().copy().reshape(parts, entries, width), flat("counts").to_numpy().copy().reshape(parts, entries)
        return b


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books | None]:
    """vectors(vec_id, embedding, label) -> (vec_id, label, code, error) for each vector kept, and the codebooks (None for no vectors)."""
    spark, emb = vectors.sparkSession, F.col("embedding")
    sound = F.coalesce(F.forall(emb, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    whole = F.transform(emb, lambda v: F.floor(v.cast("double") * scale))
    kept = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))
    lengths = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], CODES), None
    width = lengths["d"] // parts
    if lengths["d"] % parts:
        raise ValueError(f"vectors of {lengths['d']} components can't be cut into {parts} equal parts")
    fit = kept.where(F.size("v") == lengths["d"])
    first = fit.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = Books(np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).swapaxes(0, 1).copy())
    shape = books.entries.shape

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                own = batch.slice(k, BLOCK)
                x = own.column("v").flatten().to_numpy().reshape(own.num_rows, shape[0] * shape[2])
                if len(x) and np.abs(x).max(initial=0) >= 1 << 27:
                    raise ValueError("a component is too large: scaled, it has to be under 2**27")
                yield Block(own.column("vec_id"), own.column("label"), x.astype(np.int32), start).row()

    def again(now: Books):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    block = Block.of(batch, k, shape)
                    block.reassign(now)
                    yield block.row()

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block.of(batch, k, shape)
                block.reassign(books)
                code = [bytes(c).hex() for c in np.ascontiguousarray(block.own.T)]
                yield pa.RecordBatch.from_arrays([block.ids, block.labels, pa.array(code, pa.string()), pa.array(block.errors(books))], names=["vec_id", "label", "code", "error"])

    start = books
    state = materialise(fit.mapInArrow(begin, STATE), "heaps")
    for k in range(rounds):
        places = state.select(F.posexplode(F.concat("sums", "counts")).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
        held = np.array([v for _, v in sorted(places.collect())], np.int64)  # as many as the codebooks have components and entries
        sums, counts = held[: books.entries.size].reshape(shape), held[books.entries.size :].reshape(shape[:2])
        books = books.moved_to(np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books.entries))
        if k < rounds - 1:
            state, before = materialise(state.mapInArrow(again(books), STATE), "heaps"), state
            discard(before)
    codes = materialise(state.mapInArrow(finish, CODES), "codes")
    discard(state)
    rest = kept.where(F.size("v") != lengths["d"]).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return codes.unionByName(rest), books


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    # equal labels, the null one too, as a text that is never null
    codes = codes.withColumn("key", F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("none")))
    by_label = codes.groupBy("key").agg(F.sum("error").alias("label_error"))
    return join_spread(codes, by_label, "key").select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def op12_sql() -> str:
    """Seven assignments and six updates over all parts, one after the other."""
    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT))) AS r, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, label, (k - 1) // (len(e) // {PARTS}) AS part, (k - 1) % (len(e) // {PARTS}) AS pos, e[k] AS x FROM (SELECT *, unnest(range(1, len(e) + 1)) AS k FROM v)),
b0 AS MATERIALIZED (SELECT part, CAST(r - 1 AS BIGINT) AS entry, pos, x AS c FROM p WHERE r <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := d, entry := entry)) AS best FROM
  (SELECT p.r, p.part, b.entry, sum((p.x - b.c) * (p.x - b.c)) AS d FROM p JOIN b{k} b ON p.part = b.part AND p.pos = b.pos GROUP BY p.r, p.part, b.entry) GROUP BY r, part)""")
        if k < ROUNDS:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN
  (SELECT p.part, a.best.entry AS entry, p.pos, CAST(floor(CAST(sum(p.x) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM p JOIN a{k} a ON a.r = p.r AND a.part = p.part GROUP BY p.part, a.best.entry, p.pos) m
  ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)""")
    return f"""WITH {",".join(steps)},
c AS (SELECT a.r, string_agg(printf('%02x', a.best.entry), '' ORDER BY a.part) AS code, CAST(sum(a.best.d) AS BIGINT) AS error FROM a{ROUNDS} a GROUP BY a.r),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM v JOIN c ON c.r = v.r CROSS JOIN h"""
