"""Near-duplicate vectors: int8 tile products with an error bound for every vector, full precision where the bound leaves doubt.

Vectors of one label are compared block by block. Each is scaled to length 1 and written as scale * int8 codes; what the codes
miss is measured, so that |x.y - product of codes| <= e_x + (1 + e_x) * e_y. Only pairs whose product plus bound reaches the
threshold are computed again in double precision. Equal vectors are one class before any product is formed, and a tile returns
for each class its links and one root, never its pairs.

A vector that is null, empty, zero, or holds null or non-finite components, or has a null label, links with nothing; vectors of
different lengths don't link. Every row is a vector of its own, so rows with one vec_id link with each other but stay one id.
A null vec_id is null in the result and links with nothing. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import components, discard, fingerprint, join_spread, materialise, table

#: Vectors of a block, and of the slices of it that are multiplied at once.
BLOCK, SLICE = 4096, 1024
#: Products of codes stay exact in float32 up to this many dimensions at a time.
EXACT = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8 values), scales and the length of what they miss, for rows x of length 1. The last is rounded up."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None])
    missed = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
    return codes.astype(np.int8), scale, missed


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: sums of at most EXACT terms of 127 * 127 are whole numbers that float32 holds."""
    out = 0.0
    for k in range(0, a.shape[1], EXACT):
        out = out + (a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T).astype(np.float64)
    return out


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs (i of x, j of y) with cosine >= threshold, and how many pairs were computed in full. Rows have length 1."""
    (cx, sx, ex), (cy, sy, ey) = quantise(x), quantise(y)
    rows, cols, full = [], [], 0
    for i in range(0, len(x), SLICE):
        for j in range(0, len(y), SLICE):
            a, b = slice(i, i + SLICE), slice(j, j + SLICE)
            most = products(cx[a], cy[b]) * sx[a, None] * sy[b] + ex[a, None] + (1 + ex[a, None]) * ey[b]
            p, q = np.nonzero(most >= threshold - 1e-9)
            full += len(p)
            for k in range(0, len(p), 1 << 16):
                pk, qk = p[k : k + (1 << 16)] + i, q[k : k + (1 << 16)] + j
                keep = np.einsum("ij,ij->i", x[pk], y[qk]) >= threshold
                rows.append(pk[keep])
                cols.append(qk[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows) if rows else none), (np.concatenate(cols) if cols else none), full


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n by links a-b."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), one row for each row."""
    emb = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(emb, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(emb, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", "embedding", sound.alias("sound"))
    k1, k2 = fingerprint("label", "embedding")
    good = rows.where("sound").select("vec_id", "label", "embedding", k1, k2)
    classes = materialise(good.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")), "classes")

    # vectors are sent as they were given, floats in half the bytes of doubles, and become doubles in the tile
    # blocks of a label, by its number of classes; each class goes to every pair of blocks that has its own
    sizes = classes.withColumn("dim", F.size("embedding")).groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = classes.withColumn("dim", F.size("embedding")).join(sizes, ["label", "dim"]).withColumn("own", F.pmod("k1", F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("label", "dim", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "rep", "n", "embedding")

    def tile(key: tuple, t: pa.Table) -> pa.Table:
        bi, bj = key[2].as_py(), key[3].as_py()
        own, rep, n = (t.column(c).to_numpy() for c in ("own", "rep", "n"))
        x = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rep), key[1].as_py())
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        i, j, _ = linked(x[left], x[right], threshold)
        i, j = left[i], right[j]
        if bi == bj:
            i, j = i[i < j], j[i < j]
        links = np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
        order = np.argsort(rep, kind="stable")
        rank = np.argsort(order)
        root = rep[order][roots(len(rep), rank[i], rank[j])][rank]
        has = links > 0
        return pa.table({"rep": rep[has], "links": links[has].astype(np.int64), "root": root[has]})

    found = materialise(dealt.groupBy("label", "dim", "bi", "bj").applyInArrow(tile, "rep long, links long, root long"), "tiles")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_class = classes.select("label", "k1", "k2", "rep", "n").join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    by_class = by_class.select(F.col("label").alias("own_label"), "k1", F.col("k2").alias("own_k2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    by_class = materialise(by_class, "by_class")
    discard(classes, found, parts)
    # a vector may have very many copies
    joined = join_spread(good.drop("embedding"), by_class, "k1", "inner").where("label = own_label and k2 = own_k2").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len FROM embeddings),
p AS (
  SELECT a.r, b.r AS s, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r
  WHERE list_inner_product(a.e, b.e) / (a.len * b.len) >= 0.98),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
n AS (SELECT r, count(*) AS n_links FROM p GROUP BY r)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(c.least, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(c.least, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.r = v.r LEFT JOIN c ON c.a = v.vec_id
"""
