"""Jaccard join on word n-grams by MinHash banding, verified on whole n-gram sets.

A text's n-grams are the runs of N words (a shorter text is one n-gram of all its words; one without words has none and links
with nothing). Texts with equal sets are one class. Bands and rows are chosen so that a pair at the threshold meets in a band
with probability RECALL. Classes that share a band are compared by their signatures, a byte for each least hash: pairs that agree
in fewer places than all but one in 1 / MISSED of the pairs at the threshold do are left out. That takes away texts with common
boilerplate, which meet in a band now and then. What is left, directly or through others, forms candidate groups, which are cut
into tiles of TILE classes a side, and each tile computes exact intersections of the whole sets. Neither step returns pairs, only
a class's links and one root, so that large groups and bands cost rows in proportion to their size.

Null text counts as empty. Copies and repeated rows are each linked with one another; a null doc_id is kept in the result, and
takes the class of its group, or null where the group has no id. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import among, apart, components, discard, fingerprint, join_spread, materialise, table
from tidecast.llm.licenses import words_of
from tidecast.llm.neardup import roots
from tidecast.llm.repeats import mix

N, THRESHOLD, RECALL, MAX_HASHES, TILE = 5, 0.8, 0.9999, 128, 256
#: Share of the pairs at the threshold that signatures may miss, and the classes a side in which large bands are compared.
MISSED, BAND_TILE = 1e-6, 1024
U = np.uint64
STEP = U(0x9E3779B97F4A7C15 | 1)


def choose_bands(threshold: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which some number of bands, within `most` hashes, gives the recall at the threshold."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p)) if p > 0 else most + 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within that many hashes reaches the recall")
    return best


def least_matches(hashes: int, threshold: float, missed: float) -> int:
    """The most places of `hashes` in which all but a share `missed` of the pairs at the threshold agree, chance left aside."""
    below = 0.0
    for k in range(hashes + 1):
        below += math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if below > missed:
            return k
    return hashes


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = words_of(text), self.known
        if not words:
            return np.zeros(0, U)
        if len(known) > 100_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), U, len(words))
        n = min(self.n, len(h))
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out = mix(out * STEP + h[i : len(h) - n + 1 + i])
        return np.unique(out + U(n))


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1 << 62, 1 << 63, bands * rows, dtype=np.uint64) * U(2) + U(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, bytes]:
        """One hash for each band of the text's least hashes, and a byte of each of those."""
        least = np.full(len(self.a), np.iinfo(U).max, U)
        for k in range(0, len(grams), 512):
            least = np.minimum(least, (((grams[k : k + 512, None] * self.a + self.b) >> U(32))).min(0))
        band = least.reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=U) * STEP
        for i in range(self.rows):
            out = mix(out * STEP + band[:, i])
        return out.view(np.int64), least.astype(np.uint8).tobytes()


def sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """docs(id, k1, k2, text) -> (id, k1, k2, g1, g2, bands, signature): g1 and g2 stand for the set, null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, signer = Shingler(n), Signer(bands, rows)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                g1, g2, out, signatures = [], [], [], []
                for text in batch.column(3):
                    grams = shingle(text.as_py())
                    if not len(grams):
                        g1.append(None), g2.append(None), out.append(None), signatures.append(None)
                        continue
                    raw = grams.tobytes()
                    digest = xxhash.xxh3_128_intdigest(raw)
                    own, signature = signer(grams)
                    g1.append((digest >> 64) - (1 << 63)), g2.append((digest & ((1 << 64) - 1)) - (1 << 63)), out.append(own), signatures.append(signature)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(g1, pa.int64()), pa.array(g2, pa.int64()), pa.array(out, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], names=["id", "k1", "k2", "g1", "g2", "bands", "signature"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {id_type}, k1 long, k2 long, g1 long, g2 long, bands array<long>, signature binary")


def alike(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what agrees in `least` places or more, from rows `left` to rows `right` of signatures or the other way.

    A search by breadth: each row that is reached is compared with those not yet reached, so that a group of near copies costs
    one comparison a row. There are no more edges than rows.
    """
    same = len(left) == len(right) and (left == right).all()
    fresh = [np.ones(len(left), bool), np.ones(len(right), bool)]
    if same:
        fresh[1] = fresh[0]
    sides, edges = (left, right), ([], [])
    for first in range(len(left)):
        if not fresh[0][first]:
            continue
        fresh[0][first] = False
        todo = [(0, first)]
        while todo:
            side, k = todo.pop()
            rest = np.flatnonzero(fresh[1 - side])
            if not len(rest):
                continue
            own, others = sides[side][k], sides[1 - side][rest]
            hit = rest[(signatures[others] == signatures[own]).sum(1) >= least]
            fresh[1 - side][hit] = False
            edges[0].append(np.full(len(hit), own)), edges[1].append(sides[1 - side][hit])
            todo += [(0 if same else 1 - side, x) for x in hit.tolist()]
    none = np.zeros(0, np.int64)
    return (np.concatenate(edges[0]) if edges[0] else none), (np.concatenate(edges[1]) if edges[1] else none)


def alike_in_bands(dealt: DataFrame, least: int) -> DataFrame:
    """dealt(band, ti, tj, own, c, signature), a tile's rows together and in order -> edges (a, b) of classes that may be near copies.

    Small bands are compared all at once, row k with row k + 1, k + 2 and k + 3 of its tile.
    """

    def edges(t: pa.Table) -> pa.RecordBatch:
        band, ti, tj, own, c = (t.column(n).to_numpy() for n in ("band", "ti", "tj", "own", "c"))
        signatures = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(len(c), -1)
        new = np.concatenate([[True], (np.diff(band) != 0) | (np.diff(ti) != 0) | (np.diff(tj) != 0)])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(c)))
        group = np.cumsum(new) - 1
        a, b = [], []
        for step in (1, 2, 3):
            i = np.flatnonzero((group[:-step] == group[step:]) & (size[group[:-step]] <= 4)) if len(c) > step else np.zeros(0, np.int64)
            i = i[(signatures[i] == signatures[i + step]).sum(1) >= least]
            a.append(i), b.append(i + step)
        for f, n in zip(first[size > 4].tolist(), size[size > 4].tolist(), strict=True):
            rows = np.arange(f, f + n)
            x, y = alike(signatures, rows[own[rows] == ti[f]], rows[own[rows] == tj[f]], least)
            a.append(x), b.append(y)
        a, b = c[np.concatenate(a)], c[np.concatenate(b)]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            last = [t.column(n).to_numpy() for n in ("band", "ti", "tj")]
            going_on = (last[0] == last[0][-1]) & (last[1] == last[1][-1]) & (last[2] == last[2][-1])
            done = t.num_rows - int(going_on.sum())  # the last tile may go on in the next batch
            if done:
                yield edges(t.slice(0, done))
            held = t.slice(done)
        if held is not None and held.num_rows:
            yield edges(held)

    keys = ["band", "ti", "tj"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def candidates(classes: DataFrame, least: int, tile: int = BAND_TILE) -> DataFrame:
    """Edges (a, b) that connect the classes(c, bands, signature) that may be near copies."""
    spread = classes.select("c", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "tiles")
    # signatures are wide: they go to the bands that are shared alone
    bands = join_spread(spread, shared, "band", "inner").groupBy("c").agg(F.collect_list(F.struct("band", "tiles")).alias("bands"))
    each = classes.select("c", "signature").join(bands, "c").select("c", "signature", F.explode("bands").alias("x")).select("c", "signature", "x.*")
    dealt = each.withColumn("own", F.pmod(F.xxhash64("c"), F.col("tiles").cast("long")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    return alike_in_bands(dealt.select("band", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), "own", "c", "signature"), least)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right]."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, width = np.zeros((len(left), len(right)), np.float32), 4096
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (c, c + width))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], column[a:b] - c] = 1
        out += x[left] @ x[right].T
    return out


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(id, k1, k2, n_links, class_id, group, kept), one row for each row of docs.

    n_links: other rows whose sets have a Jaccard similarity of threshold or more; class_id: smallest id reachable over links;
    group: a number of that class, null for a row that links with nothing; k1, k2: fingerprint of the text.
    """
    bands, per_band = choose_bands(threshold, recall)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).select("id", *fingerprint("text"), "text")
    signed = materialise(sign(texts, n, bands, per_band), "signed")
    # one row for each distinct set, with a number and the fingerprint of one of its texts
    sets = signed.where("g1 is not null").groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"), F.min(F.struct("k1", "k2")).alias("k"), F.max("bands").alias("bands"), F.max("signature").alias("signature"))
    classes = materialise(sets.withColumn("c", F.monotonically_increasing_id()).select("c", "g1", "g2", "n", "least_id", "k.k1", "k.k2", "bands", "signature"), "classes")
    groups = components(candidates(classes, least_matches(bands * per_band, threshold, MISSED)))

    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    wanted = materialise(groups.join(sizes, "component").join(classes.select(F.col("c").alias("id"), "n", "k1", "k2"), "id").withColumnRenamed("id", "c"), "candidates")
    # copies of a text meet in the tasks that read them, before anything is shuffled
    once = among(texts.select("k1", "k2", "text"), wanted.select("k1")).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    dealt = once.join(wanted, ["k1", "k2"]).withColumn("own", F.pmod(F.xxhash64("c"), F.col("tiles").cast("long")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    dealt = dealt.select("component", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), "own", "c", "n", "text")

    def verify(key: tuple, t: pa.Table) -> pa.Table:
        ti, tj, shingle = key[1].as_py(), key[2].as_py(), Shingler(n)
        own, c, weight = (t.column(x).to_numpy() for x in ("own", "c", "n"))
        own_sets = [shingle(x) for x in t.column("text").to_pylist()]
        size = np.array([len(s) for s in own_sets])
        left, right = np.flatnonzero(own == ti), np.flatnonzero(own == tj)
        both = overlaps(own_sets, left, right).astype(np.float64) if len(left) and len(right) else np.zeros((len(left), len(right)))
        i, j = np.nonzero(both >= threshold * (size[left][:, None] + size[right] - both) - 1e-9)
        i, j = left[i], right[j]
        keep = (i < j) if ti == tj else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        links = np.bincount(i, weight[j], len(c)) + np.bincount(j, weight[i], len(c))
        order = np.argsort(c, kind="stable")
        rank = np.argsort(order)
        root = c[order][roots(len(c), rank[i], rank[j])][rank]
        has = links > 0
        return pa.table({"c": c[has], "links": links[has].astype(np.int64), "root": root[has]})

    found = materialise(dealt.groupBy("component", "ti", "tj").applyInArrow(verify, "c long, links long, root long"), "verified")
    discard(wanted, groups)
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    known = materialise(classes.select("c", "g1", "g2", "n", "least_id").join(links, "c", "left").join(parts.withColumnRenamed("id", "c"), "c", "left").withColumn("group", F.coalesce("component", "c")), "known")
    discard(classes, found, parts)
    names = known.groupBy("group").agg(F.min("least_id").alias("class_id"), F.sum("n").alias("members"))
    by_set = known.join(names, "group").select("g1", "g2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_id", F.when(F.col("members") > 1, F.col("group")).alias("group"))
    rows = signed.select("id", "k1", "k2", "g1", "g2")
    out = rows.where("g1 is not null").join(by_set, ["g1", "g2"]).select("id", "k1", "k2", "n_links", "class_id", "group")
    alone = rows.where("g1 is null").select("id", "k1", "k2", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("class_id"), F.lit(None).cast("long").alias("group"))
    return out.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("class_id"))).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest id (any one of several with that id)."""
    found = materialise(near_texts(docs, id_col, text_col, **options).select(F.col(id_col).alias("_id"), "k1", "k2", "group", "kept").where("group is not null"), "near")
    gone = found.where("not kept").select("_id", "k1", "k2").distinct()
    k1, k2 = fingerprint(F.coalesce(text_col, F.lit("")))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_id"), k1, k2)
    # rows that share both group and smallest id are rare, but may be there: of those one stays
    kept = found.where("kept")
    twice = kept.groupBy("group").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("group")
    again = materialise(kept.join(twice, "group").select("_id", "k1", "k2", "group").distinct(), "twice")
    judged = gone.withColumn("group", F.lit(None).cast("long")).withColumn("gone", F.lit(True)).unionByName(again.withColumn("gone", F.lit(False)))
    judged = materialise(judged, "judged").withColumnsRenamed({"_id": "j_id", "k1": "j1", "k2": "j2"})
    # few rows may be concerned: only their texts are shuffled
    met = among(keyed, judged.select(F.col("j1").alias("k1"))).join(judged, F.col("_id").eqNullSafe(F.col("j_id")) & (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left").where("gone is null or not gone")
    untouched = apart(keyed, judged.select(F.col("j1").alias("k1"))).select("row.*").unionByName(met.where("group is null").select("row.*"))
    if again.isEmpty():
        return untouched
    return untouched.unionByName(met.where("group is not null").dropDuplicates(["group"]).select("row.*"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_links", "class_id", "kept")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [list_aggregate(words, 'string_agg', ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' ')) END) AS s FROM w),
k AS (SELECT g.r, hash(u.x) AS h FROM g, unnest(g.s) AS u(x)),
p AS (
  SELECT a.r AS a, b.r AS b FROM k a JOIN k b ON a.h = b.h AND a.r <> b.r GROUP BY a.r, b.r
  HAVING count(*) * 10 >= 8 * ((SELECT len(s) FROM g WHERE r = a.r) + (SELECT len(s) FROM g WHERE r = b.r) - count(*))),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
c AS (SELECT reach.a, min(g.doc_id) AS least FROM reach JOIN g ON g.r = reach.b GROUP BY reach.a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT g.doc_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, least(g.doc_id, coalesce(c.least, g.doc_id)) AS class_id,
       g.doc_id = least(g.doc_id, coalesce(c.least, g.doc_id)) AS kept
FROM g LEFT JOIN n ON n.a = g.r LEFT JOIN c ON c.a = g.r
"""
