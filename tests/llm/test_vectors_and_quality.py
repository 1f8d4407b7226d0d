"""Hard negatives, code compression and quality scores against brute force and held-out labels, with odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tidecast.llm import lloyd, negatives, quality

RNG = np.random.default_rng(21)
ODD = [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [None] * 8, 1), (903, [float("inf")] * 8, 0)]


def vectors(n, d=8, copies=30):
    base = RNG.normal(size=(n, d)).round(2)
    base[:copies] = base[0]
    return [(i, [float(v) for v in x], i % 3) for i, x in enumerate(base)]


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# op11


def mined(rows, every, positives, count, window=(50, 95)):
    """Plain search: rows of (position, id, label, whole vector)."""
    out = []
    for a in rows:
        if a[1] is None or a[1] % every:
            continue
        scores = [(-int(np.dot(a[3], b[3])), b[1], b[0], b[2]) for b in rows if b[0] != a[0] and len(b[3]) == len(a[3]) and b[1] is not None and b[2] is not None]
        if a[2] is None:
            continue
        for p in sorted(s for s in scores if s[3] == a[2])[:positives]:
            left = sorted(s for s in scores if s[3] != a[2] and window[0] * -p[0] <= 100 * -s[0] <= window[1] * -p[0])
            out += [(a[1], p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(left[:count])]
    return sorted(out)


@pytest.mark.parametrize("tile", [(8192, 8192), (40, 7)])
def test_hard_negatives_by_brute_force(spark, tile):
    rows = [(i, [int(x * 64) for x in v], c) for i, v, c in vectors(260)]
    rows += [(500, [1, 2, 3], 0), (505, [3, 2, 1], 0), (510, [2, 1, 2], 1), (10, rows[3][1], 1), (None, rows[0][1], 0), (515, rows[5][1], None), (520, [], 0), (525, [0] * 8, 2)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, v array<bigint>, label int, uid int")
    got = negatives.hard_negatives(frame, "vec_id % 5 = 0", 5, 3, (50, 95), *tile)
    want = mined([(k, i, c, v) for k, (i, v, c) in enumerate(rows) if v], 5, 5, 3)
    assert sorted(map(tuple, got.collect())) == want
    assert negatives.hard_negatives(frame.limit(0), "true").count() == 0 == negatives.hard_negatives(frame, "vec_id < 0").count()


def test_looked_up_sums_stay_within_their_bound_and_spare_exact_products():
    x = RNG.normal(size=(3000, 16)) * 200
    x = np.floor(x).astype(np.int64)
    books = negatives.codebooks(x[:500])
    codes, reach = negatives.encode(x, books)
    q = x[:40]
    tables = [(book @ q[:, 2 * p : 2 * p + 2].T.astype(float)).astype(np.float32) for p, book in enumerate(books)]
    total = sum(t[codes[:, p]] for p, t in enumerate(tables))
    assert (np.abs(total - x @ q.T) <= reach[:, None] * np.sqrt((q * q).sum(1))).all()
    free, ends = lambda some, rows: np.ones((rows.stop - rows.start, some.stop - some.start), bool), np.full((40, 1), np.inf)
    best, reranked = negatives.search(q, x, np.arange(3000), codes, reach, books, free, -ends, ends, 5)
    want = np.sort(-(x @ q.T), 0)[:5].T
    assert (-best.score.reshape(40, 5) == want).all() and reranked < 0.2 * 40 * 3000


# op12


def plain_lloyd(rows, parts, entries, rounds, scale=4096):
    kept = [(i, c, np.floor(np.array(v, np.float32).astype(float) * scale).astype(int)) for i, v, c in rows if sound(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    x = np.array([v for _, _, v in kept])
    own = x.reshape(len(x), parts, -1)
    books = own[:entries].swapaxes(0, 1).copy()

    def assign():
        return (((own[:, :, None] - books[None]) ** 2).sum(3)).argmin(2), ((own[:, :, None] - books[None]) ** 2).sum(3).min(2)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (at[:, p] == e).any():
                    mine = own[at[:, p] == e, p]
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    at, d = assign()
    return [(i, c, "".join(f"{k:02x}" for k in a), int(e)) for (i, c, _), a, e in zip(kept, at, d.sum(1), strict=True)], books


def test_codes_by_plain_lloyd(spark, monkeypatch):
    rows = vectors(300) + ODD + [(None, [0.5] * 8, 2), (7, [0.25] * 8, None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, code int")
    want, books = plain_lloyd(rows, 4, 5, 6)
    for block in (4096, 40):
        monkeypatch.setattr(lloyd, "BLOCK", block)
        got, found = lloyd.compress(frame, parts=4, entries=5)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert (found.entries == books).all() and found.digest() == hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def test_heaps_pop_few_parts_once_entries_stand_still_and_none_too_few():
    x = (RNG.normal(size=(2000, 6)) * 3000).astype(np.int32) + RNG.integers(0, 4, (2000, 1)).astype(np.int32) * 20000
    books = lloyd.Books(x[:8].astype(np.int64).reshape(8, 2, 3).swapaxes(0, 1).copy())
    ids = lloyd.pa.array(range(2000))
    block, scanned = lloyd.Block(ids, ids, x, books), []
    for _ in range(12):
        books = books.moved_to(np.where(block.counts[..., None] > 0, block.sums // np.maximum(block.counts, 1)[..., None], books.entries))
        block.reassign(books)
        scanned.append(block.scanned)
        plain = lloyd.Block(ids, ids, x, lloyd.Books(books.entries))
        assert (block.own == plain.own).all() and (block.sums == plain.sums).all() and (block.counts == plain.counts).all()
        again = lloyd.Block.of(block.row(), 0, books.entries.shape)
        assert (again.heaps == block.heaps).all() and (again.keys == block.keys).all()
    assert scanned[-1] < 0.5 * 2 * 2000


def test_compression_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    none, books = lloyd.compress(spark.createDataFrame(ODD, schema))
    assert none.count() == 0 and books is None
    few, books = lloyd.compress(spark.createDataFrame([(3, [1.0] * 8, 1), (2, [0.5] * 8, 1), (1, [1.0, 2.0], 1), (0, [], 1)], schema))
    assert {r.vec_id: (r.code, r.error) for r in few.collect()} == {3: ("01" * 8, 0), 2: ("00" * 8, 0), 1: (None, None), 0: (None, None)}
    with pytest.raises(ValueError):
        lloyd.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], schema))


# op13


def test_buckets_follow_the_bytes_of_words():
    words = quality.Words()
    of = lambda t: [int(b) for b in words.of(np.frombuffer(t.encode(), np.uint8))[1]]
    assert of("ab cd ab") == [of("ab")[0], of("cd")[0], of("ab")[0]] and of("x" * 5000 + " ab")[1] == of("ab")[0]
    assert of("ab!!cd") == of("ab !! cd") and of("") == [] == of("\n \t") and of("é")[0] != of("e")[0]


def test_context_vectors_are_sums_of_neighbours_index_vectors(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, ""]
    index, words = quality.index_vectors().astype(int), quality.Words()
    want = np.zeros((1 << quality.BITS, quality.DIM), int)
    for t in texts:
        own = words.of(np.frombuffer((t or "").encode(), np.uint8))[1]
        for i, a in enumerate(own):
            for j in range(max(0, i - quality.SPAN), min(len(own), i + quality.SPAN + 1)):
                if i != j:
                    want[a] += index[own[j]]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert (quality.context_vectors(frame) == want).all()
    # pieces, and bundles of texts, change no mean
    vectors = quality.word_vectors(want)
    whole = quality.Pool(vectors).of(texts)
    monkeypatch.setattr(quality, "TOGETHER", 50)
    assert np.allclose(quality.Pool(vectors).of(texts), whole, atol=1e-5) and not whole[-1].any()
    monkeypatch.setattr(quality, "PIECE", 17)
    assert np.allclose(quality.Pool(vectors).of(texts)[:, : 2 * quality.DIM], whole[:, : 2 * quality.DIM], atol=1e-5)


def test_gradients_and_temperature():
    x, y = RNG.normal(size=(50, 4)), (RNG.random(50) > 0.5).astype(float)
    s = quality.Scorer(x, y, hidden=3, epochs=2)
    loss = lambda: float(np.mean(np.logaddexp(0, s.logits(x)) - y * s.logits(x)))
    for own, g in zip(s.p, s.gradients((x - s.mean) / s.sd, y), strict=True):
        for at in np.ndindex(own.shape):
            held = own[at]
            own[at] = held + 1e-6
            up = loss()
            own[at] = held - 1e-6
            assert abs((up - loss()) / 2e-6 - g[at]) < 1e-6
            own[at] = held
    z = RNG.normal(size=4000) * 2
    truth = (RNG.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert 1.8 < quality.calibrated(2 * z, truth) < 2.2


def test_quality_of_odd_tables_and_of_held_out_documents(spark, tmp_path):
    def run(docs, labels):
        for name, rows, schema in (("documents", docs, "doc_id long, text string, source string"), ("labels", labels, "doc_id long, quality int, toxic int")):
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return quality.op13_quality_classifier(spark, str(tmp_path)).collect()

    docs = [(1, "a b", "x"), (2, None, "x"), (None, "", "x"), (2, "😀" * 10, None)]
    assert run([], []) == [] and {r.score for r in run(docs, [])} == {0.5} and {r.predicted for r in run(docs, [(1, 1, 0), (1, None, 0)])} == {1}
    got = {r.doc_id: r for r in quality.op13_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(got[i].predicted, q) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(p == q for p, q in held) > 0.93 * len(held) and sum(p for p, q in held if q) > 0.95 * sum(q for _, q in held)
