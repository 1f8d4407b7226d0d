"""Hard-negative mining: product quantisation with stored residual norms, and an exact rerank of what its bounds leave.

Every row has a code: by part the nearest codebook entry, and the norm of what the code misses. A query's table holds its products with
all entries; a row's looked-up sum is its score but for an error of at most |query| * residual norm, widened by what single precision
can miss. So a row can be left out only where that interval proves that it can't enter: below the k-th best score seen so far, or
outside a window. What is left is computed again in whole numbers.

Queries (anchors) are taken in blocks against blocks of rows. A tile has one of each and gives, for each anchor, its best k rows at
most; the best of all tiles are the result. First the positives are found, which set each window, then the negatives in it. A row is
sent once for each block of anchors. Of rows with equal vector and label only the first few by id can be in any result, as ties go by
id; the others are left out before, but stay anchors.

The codebooks are fitted on a bounded sample (about TRAIN rows, by hash); every row is indexed, and results are exact whatever the
codebooks are. Rows with a null id, label or vector, or a null or non-finite component take no part. Vectors of different lengths are
not compared. Each row is a row of its own, so repeated ids can be each other's partners. Components must keep scores within 2**62,
anything else is an error. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.common import discard, fingerprint, materialise, table

#: Components of a part, entries of its codebook, rows that codebooks are fitted on, on average.
WIDTH, ENTRIES, TRAIN = 2, 256, 10_000
#: Rows and anchors of a tile on average, and those looked up at once.
ROWS, ANCHORS, SLICE, CHUNK = 8192, 8192, 128, 2048
FOUND = "anchor bigint, slot int, uid bigint, vec_id bigint, score bigint"


def codebooks(x: np.ndarray, width: int = WIDTH, entries: int = ENTRIES, rounds: int = 8, seed: int = 3) -> list[np.ndarray]:
    """Entries of each part by a few rounds of Lloyd's algorithm from distinct rows."""
    rng, books = np.random.default_rng(seed), []
    for k in range(0, x.shape[1], width):
        own = x[:, k : k + width].astype(float)
        distinct = np.unique(own, axis=0)
        book = distinct[rng.permutation(len(distinct))[:entries]]
        for _ in range(rounds):
            at = nearest(own, book)
            count = np.bincount(at, minlength=len(book))
            sums = np.stack([np.bincount(at, own[:, j], len(book)) for j in range(own.shape[1])], 1)
            book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
        books.append(book)
    return books


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k in range(0, len(x), CHUNK):
        own = x[k : k + CHUNK]
        out[k : k + CHUNK] = ((book * book).sum(1) - 2 * own @ book.T).argmin(1)
    return out


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, part) and for each row the factor of |query| that bounds how far a looked-up sum is from the score."""
    width, missed, codes = books[0].shape[1], np.zeros(len(x)), np.zeros((len(x), len(books)), np.uint8)
    for p, book in enumerate(books):
        own = x[:, p * width : (p + 1) * width].astype(float)
        codes[:, p] = nearest(own, book)
        missed += ((own - book[codes[:, p]]) ** 2).sum(1)
    residual, norm = np.sqrt(missed), np.sqrt((x.astype(float) ** 2).sum(1))
    return codes, residual * (1 + 1e-9) + (len(books) + 4) * 2.0**-23 * (norm + residual)


class Best:
    """The best k rows of each slot so far, by score and then id, as sorted columns; floor: the k-th score of each slot."""

    def __init__(self, slots: int, k: int, least: np.ndarray):
        self.k, self.slots, self.floor = k, slots, least.copy()
        self.slot, self.row, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, row, score = np.r_[self.slot, slot], np.r_[self.row, row], np.r_[self.score, score]
        order = np.lexsort((row, ids[row], -score, slot))
        slot, row, score = slot[order], row[order], score[order]
        first = np.searchsorted(slot, slot, "left")
        keep = np.arange(len(slot)) - first < self.k
        self.slot, self.row, self.score = slot[keep], row[keep], score[keep]
        last = np.arange(len(slot)) - first == self.k - 1
        self.floor[slot[last]] = np.maximum(self.floor[slot[last]], score[last])


def search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, reach: np.ndarray, books: list[np.ndarray], admits, low: np.ndarray, high: np.ndarray, k: int) -> tuple[Best, int]:
    """The best k rows of x for each slot: anchor a's slot s takes rows that admits(anchors, rows) and scores in [low, high][a, s].

    low and high are doubles that hold whole numbers (or are infinite; an empty window: low > high). Also given: pairs reranked.
    """
    a, s = low.shape
    width, best, reranked = books[0].shape[1], Best(a * s, k, low.ravel()), 0
    wide = np.sqrt((q.astype(float) ** 2).sum(1)) * (1 + 1e-9)
    for i in range(0, a, SLICE):
        some = slice(i, min(i + SLICE, a))
        if not (low[some] <= high[some]).any():
            continue
        tables = [np.ascontiguousarray((book @ q[some, p * width : (p + 1) * width].T.astype(float)).astype(np.float32)) for p, book in enumerate(books)]
        top = np.where(low[some] <= high[some], high[some], -np.inf)
        # a short first chunk, so that the scores to beat are known early
        cuts = [0, *range(min(256, len(x)), len(x), CHUNK), len(x)]
        for j, end in zip(cuts, cuts[1:]):
            rows = slice(j, end)
            total = tables[0][codes[rows, 0]]
            for p in range(1, len(books)):
                total += tables[p][codes[rows, p]]
            off = reach[rows, None] * wide[some]
            # inside the hull of an anchor's windows first, since most rows are not
            floor = np.where(low[some] <= high[some], best.floor.reshape(a, s)[some], np.inf)
            may = (total + off >= floor.min(1)) & (total - off <= top.max(1))
            may &= admits(some, rows)
            r, c = np.nonzero(may)
            for m in range(0, len(r), 1 << 16):
                rm, cm = r[m : m + (1 << 16)] + j, c[m : m + (1 << 16)] + i
                least, most = total[rm - j, cm - i] - off[rm - j, cm - i], total[rm - j, cm - i] + off[rm - j, cm - i]
                here = best.floor.reshape(a, s)[cm]
                fits = (most[:, None] >= here) & (least[:, None] <= high[cm]) & (low[cm] <= high[cm])
                some_fit = fits.any(1)
                rm, cm, fits = rm[some_fit], cm[some_fit], fits[some_fit]
                reranked += len(rm)
                exact = np.einsum("ij,ij->i", x[rm], q[cm])
                fits &= (exact[:, None] >= best.floor.reshape(a, s)[cm]) & (exact[:, None] <= high[cm])
                at, slot = np.nonzero(fits)
                best.add(cm[at] * s + slot, rm[at], exact[at], ids)
    return best, reranked


def indexed(rows: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """rows with code and reach added."""
    held = rows.sparkSession.sparkContext.broadcast(books)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("v")], np.int64)
            for d in np.unique(sizes):
                own = batch.filter(pa.array(sizes == d))
                x = own.column("v").flatten().to_numpy().reshape(own.num_rows, d)
                if float(np.abs(x.astype(float)).max(initial=0)) ** 2 * d >= 2.0**62:
                    raise ValueError("a component is too large for whole scores")
                codes, reach = encode(x, held.value[int(d)])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(reach)], names=[*own.schema.names, "code", "reach"])

    return rows.mapInArrow(run, f"{fields}, code binary, reach double")


def hard_negatives(vectors: DataFrame, anchor: str, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), rows_of_tile: int = ROWS, anchors_of_tile: int = ANCHORS) -> DataFrame:
    """vectors(vec_id, label, v array<bigint>) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: an SQL condition on vec_id. A row's positives are its best `positives` rows of the same label; a positive's negatives are the
    best `negatives` rows of other labels whose score is between window's hundredths of the positive's. All, if there are fewer.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and label is not null and v is not null and size(v) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<bigint>").alias("v"))
    # ids of our own, which stay since the table is written
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("uid"), *rows.columns), "rows")
    share = TRAIN / max(rows.count(), 1)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(17), "vec_id", "v"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < share).select("v").limit(2 * TRAIN).collect()
    lengths = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()]
    books = {}
    for d in lengths:
        own = sorted(r["v"] for r in sample if len(r["v"]) == d) or [[0] * d]
        books[d] = codebooks(np.array(own, np.int64), WIDTH if d % WIDTH == 0 else 1)
    same = Window.partitionBy("label", *fingerprint("v")).orderBy("vec_id", "uid")
    few = rows.withColumn("turn", F.row_number().over(same)).where(F.col("turn") <= max(positives + 1, negatives)).drop("turn")
    index = materialise(indexed(few, books), "index")
    asked = rows.where(anchor)
    n_rows, n_asked = index.count(), asked.count()
    if not n_rows or not n_asked:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    row_blocks, anchor_blocks = -(-n_rows // rows_of_tile), -(-n_asked // anchors_of_tile)
    dealt = index.select(F.size("v").alias("d"), F.pmod(F.xxhash64(F.lit(5), "uid"), F.lit(row_blocks)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("ab"), "uid", "vec_id", "label", "v", "code", "reach")
    queries = asked.select(F.size("v").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), F.pmod(F.xxhash64(F.lit(5), "uid"), F.lit(anchor_blocks)).cast("int").alias("ab"), F.col("uid").alias("anchor"), "label", "v")
    held = spark.sparkContext.broadcast(books)
    keys = ["d", "rb", "ab"]

    def arrays(t: pa.Table, d: int) -> tuple[np.ndarray, ...]:
        return t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, d), t.column("label").to_numpy()

    def found(q: pa.Table, r: pa.Table, low: np.ndarray, high: np.ndarray, k: int, positive: bool) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({c.split(" ")[0]: pa.array([], pa.int32() if c.endswith(" int") else pa.int64()) for c in FOUND.split(", ")})
        d = q.column("d")[0].as_py()
        (x, label), (qx, q_label) = arrays(r, d), arrays(q, d)
        uid, ids, anchors = r.column("uid").to_numpy(), r.column("vec_id").to_numpy(), q.column("anchor").to_numpy()
        codes = np.frombuffer(b"".join(r.column("code").to_pylist()), np.uint8).reshape(len(x), -1)

        def admits(some: slice, rows: slice) -> np.ndarray:
            same = label[rows, None] == q_label[some]
            return same & (uid[rows, None] != anchors[some]) if positive else ~same

        best, _ = search(qx, x, ids, codes, r.column("reach").to_numpy(), held.value[d], admits, low, high, k)
        s = low.shape[1]
        return pa.table({"anchor": anchors[best.slot // s], "slot": (best.slot % s).astype(np.int32), "uid": uid[best.row], "vec_id": ids[best.row], "score": best.score})

    def near(q: pa.Table, r: pa.Table) -> pa.Table:
        ends = np.full((q.num_rows, 1), np.inf)
        return found(q, r, -ends, ends, positives, True)

    def within(q: pa.Table, r: pa.Table) -> pa.Table:
        low, high = (np.full((q.num_rows, positives), end) for end in (np.inf, -np.inf))
        for i, own in enumerate(q.column("scores").to_pylist()):
            for j, score in enumerate(own):
                low[i, j], high[i, j] = -(-window[0] * score // 100), window[1] * score // 100
        return found(q, r, low, high, negatives, False)

    def first(rows: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "uid")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best = first(queries.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(near, FOUND), positives, "anchor")
    best = materialise(best.select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("own")).select("anchor", F.col("own.positive_score").alias("scores"))
    mined = queries.join(scores, "anchor").groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(within, FOUND)
    mined = first(mined, negatives, "anchor", "slot").select("anchor", (F.col("slot") + 1).alias("slot"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = mined.join(best, ["anchor", "slot"]).join(asked.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    out = materialise(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
    discard(rows, index, best)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = F.col("embedding")
    sound = F.col("label").isNotNull() & F.coalesce(F.forall(emb, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").where(sound).select("vec_id", label.alias("label"), F.transform(emb, lambda v: F.floor(v.cast("double") * 256)).alias("v"))
    return hard_negatives(rows, "vec_id % 50 = 0")


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.u AS au, a.vec_id AS anchor_id, b.u AS bu, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.u <> b.u AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT au, anchor_id, bu, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY au ORDER BY score DESC, vec_id, bu) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.au = p.au AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.au, p.bu ORDER BY s.score DESC, s.vec_id, s.bu) QUALIFY row_number() OVER w <= 3
"""
