"""Removal of long repeats: every byte covered by a string of LENGTH bytes that also starts anywhere else.

Prefix doubling ranks all positions by ever longer prefixes and keeps those whose rank is shared. Over every byte position each
round would write some twenty bytes a position, many times the input. So ranks are fingerprints (two 64-bit ones where they
decide), and positions are taken in runs:

1. Every window of LENGTH bytes has a least K-gram (by hash, leftmost). Equal windows have it at the same offset, so windows are
   dealt into runs of neighbouring starts with one such anchor, and equal windows lie in runs of equal anchor rank. Rank K: a
   run whose anchor is unique holds no repeat and is dropped.
2. Rank past LENGTH: a run's whole stretch, from its first window's first byte to its last window's last. Shared by another
   run, all its windows are repeats.
3. What is undecided (runs that hold the edge of a match) is ranked window by window at LENGTH, among the runs of equal anchor,
   each distinct stretch once. An anchor with more than GROUP distinct stretches is split: its runs are cut by the distance from
   the anchor, the bytes that all windows of a cut have in common are its core, and only cuts with a shared core and a stretch
   of their own are ranked window by window, by a shuffle on window fingerprints. No group of rows meets in one task.

The same is done over words (runs of bytes other than white space) for strings of WORDS words, each counted once a document: how
many of them stand in another document too is reported beside the bytes, as a passage may have many words and few bytes.

Matches never cross documents. Null text counts as empty, a text shorter than LENGTH loses nothing, copies lose everything, and
so do repeated rows, each of which is a document; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import HOT, among, discard, fingerprint, join_spread, materialise, table

LENGTH, K, GROUP = 400, 64, 256
#: Words of a shared passage, and of the grams that anchor them.
WORDS, WORD_K = 50, 8
#: Bytes that are hashed at once in a task; longer texts are taken in pieces that overlap.
CHUNK = 1 << 20
U = np.uint64
#: Two bases with their inverses modulo 2**64, and a random odd number for each byte value.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 5)
BYTES = np.random.default_rng(2024).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: The two kinds of unit that strings are counted in; the lowest bit of an anchor tells which.
IN_BYTES, IN_WORDS = 0, 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class Powers:
    def __init__(self):
        self.of: list[tuple[np.ndarray, np.ndarray]] = []

    def get(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.of or len(self.of[0][0]) < n:
            self.of = []
            for base in BASES:
                pair = []
                for b in (base, pow(base, -1, 1 << 64)):
                    steps = np.full(n, b, U)
                    steps[0] = 1
                    pair.append(np.multiply.accumulate(steps))
                self.of.append((pair[0], pair[1]))
        return self.of


class Hashes:
    """Fingerprints of all substrings of values, from sums over its prefixes."""

    def __init__(self, values: np.ndarray, powers: Powers):
        n = len(values)
        self.sums, self.inverse = [], []
        for forth, back in powers.get(n + 1):
            s = np.zeros(n + 1, U)
            np.cumsum(values * forth[:n], out=s[1:])
            self.sums.append(s)
            self.inverse.append(back)

    def of(self, low: np.ndarray, high: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return mix((s[high] - s[low]) * self.inverse[which][low] + (high - low).astype(U) * U(0x94D049BB133111EB))

    def grams(self, k: int) -> np.ndarray:
        s = self.sums[0]
        n = len(s) - k
        return mix((s[k:] - s[:n]) * self.inverse[0][:n]) if n > 0 else np.zeros(0, U)


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(U).max, U)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, 1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def in_words(raw: bytes, powers: Powers) -> np.ndarray:
    """A fingerprint for each word of raw, in order."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], WHITE[data], [True]]).astype(np.int8)))
    return Hashes(BYTES[data], powers).of(edge[::2], edge[1::2]) if len(edge) else np.zeros(0, U)


def runs(values: np.ndarray, first: np.ndarray, end: np.ndarray, length: int, k: int, powers: Powers, kind: int = IN_BYTES) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, in texts that lie at first..end in values: text, lo, hi (window starts), a, s1, s2.

    Of words, a window that stands before in the same text is left out.
    """
    none = {n: np.zeros(0, U if n in ("a", "s1", "s2") else np.int64) for n in ("text", "lo", "hi", "a", "s1", "s2")}
    full = end - first >= length
    if not full.any():
        return none
    h = Hashes(values, powers)
    g = h.grams(k)
    keyed = (g & ~U(0xFFFFFFFF)) | np.arange(len(g), dtype=U)
    anchor = (least_in_windows(keyed, length - k + 1) & U(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int64)
    np.add.at(valid, first[full], 1)
    np.add.at(valid, end[full] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid)[:-1])
    if kind == IN_WORDS:
        text = np.searchsorted(first, at, "right").astype(U)
        at = np.sort(at[np.unique(mix(h.of(at, at + length) + text * U(BASES[1])), return_index=True)[1]])
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(anchor[at]) != 0)) + 1
    lo, hi = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    return {"text": np.searchsorted(first, lo, "right") - 1, "lo": lo, "hi": hi, "a": g[anchor[lo]] & ~U(1) | U(kind), "s1": h.of(lo, hi + length), "s2": h.of(lo, hi + length, 1)}


def pieces(texts: list, length: int, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined up to CHUNK units: data, first and end of each, its number and its offset.

    Longer ones come in overlapping pieces, or by themselves where they have to stay whole.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        step = len(text) if whole else CHUNK
        for at in range(0, max(1, len(text) - length + 1), step):
            piece = text[at : at + step + length - 1]
            if held and size + len(piece) > CHUNK:
                yield joined(held)
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield joined(held)


def joined(held: list) -> tuple:
    end = np.cumsum([len(p) for _, _, p in held])
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8) if isinstance(held[0][2], bytes) else np.concatenate([p for _, _, p in held])
    return data, end - [len(p) for _, _, p in held], end, np.array([i for i, _, _ in held]), np.array([a for _, a, _ in held])


def raw_texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def find_runs(docs: DataFrame, length: int, k: int, words: int, word_k: int) -> DataFrame:
    """docs(k1, k2, text) -> (k1, k2, lo, hi, a, s1, s2), of bytes and of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                k1, k2 = (batch.column(c).to_numpy() for c in (0, 1))
                texts = raw_texts(batch.column(2))
                for data, first, end, number, offset in pieces(texts, length):
                    yield from as_batch(runs(BYTES[data], first, end, length, k, powers), k1, k2, number, offset - first)
                for data, first, end, number, offset in pieces([in_words(t, powers) if len(t) >= 2 * words - 1 else t[:0] for t in texts], words, whole=True):
                    yield from as_batch(runs(data, first, end, words, word_k, powers, IN_WORDS), k1, k2, number, offset - first)

    def as_batch(r: dict, k1: np.ndarray, k2: np.ndarray, number: np.ndarray, shift: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(r["lo"]):
            text, shift = number[r["text"]], shift[r["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[text], k2[text], (r["lo"] + shift).astype(np.int64), (r["hi"] + shift).astype(np.int64), r["a"].view(np.int64), r["s1"].view(np.int64), r["s2"].view(np.int64))], names=["k1", "k2", "lo", "hi", "a", "s1", "s2"])

    return docs.mapInArrow(run, "k1 long, k2 long, lo long, hi long, a long, s1 long, s2 long")


CONTEXT = {"a": pa.int64(), "large": pa.bool_(), "k1": pa.int64(), "k2": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "open": pa.bool_(), "units": pa.binary()}
SQL_NAMES = {pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}


def cut_contexts(wanted: DataFrame, length: int, words: int) -> DataFrame:
    """wanted(text, runs array<struct<a,large,k1,k2,lo,hi,open>>) -> a row for each run, with the units of all its windows.

    Units are the bytes themselves, or the fingerprints of the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, powers = None, Powers()
        for batch in batches:
            rows, size = [], 0
            for text, own in zip(batch.column(0), batch.column(1), strict=True):
                own = own.as_py()
                key = (own[0]["k1"], own[0]["k2"])
                if key == last:
                    continue  # a copy
                last, raw = key, (text.as_py() or "").encode("utf-8", "surrogatepass")
                by_word = in_words(raw, powers) if any(r["a"] & 1 for r in own) else None
                for r in own:
                    units = by_word[r["lo"] : r["hi"] + words].tobytes() if r["a"] & 1 else raw[r["lo"] : r["hi"] + length]
                    rows.append(r | {"units": units})
                    size += len(units)
                    if size > 1 << 21:
                        yield as_batch(rows)
                        rows, size = [], 0
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in CONTEXT.items()], names=list(CONTEXT))

    return wanted.mapInArrow(run, ", ".join(f"{n} {SQL_NAMES[k]}" for n, k in CONTEXT.items()))


class Windows:
    """Every window of some contexts of one kind: which context it is in (own), its start there (step) and fingerprints."""

    def __init__(self, contexts: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int, kind: int, powers: Powers):
        values = np.frombuffer(b"".join(contexts), U) if kind == IN_WORDS else BYTES[np.frombuffer(b"".join(contexts), np.uint8)]
        sizes = np.array([len(c) for c in contexts], np.int64) // (8 if kind == IN_WORDS else 1)
        self.begin, many = np.cumsum(sizes) - sizes, hi - lo + 1
        self.own = np.repeat(np.arange(len(contexts)), many)
        self.step = np.arange(len(self.own)) - np.repeat(np.cumsum(many) - many, many)
        self.length, self.hashes = length, Hashes(values, powers)

    def of(self, which: int, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        at = self.begin[self.own[some]] + self.step[some]
        return self.hashes.of(at, at + self.length, which)


def by_kind(t: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    kinds = t.column("a").to_numpy() & 1
    for kind in (IN_BYTES, IN_WORDS):
        if (kinds == kind).any():
            yield kind, t.filter(pa.array(kinds == kind))


PLACES = "k1 long, k2 long, words boolean, lo long, hi long"


def places(k1: np.ndarray, k2: np.ndarray, kind: int, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, np.full(len(k1), kind == IN_WORDS), lo.astype(np.int64), hi.astype(np.int64))], names=["k1", "k2", "words", "lo", "hi"])


def resolve(contexts: DataFrame, length: int, words: int, at_once: int = 300_000) -> DataFrame:
    """Stretches of repeated window starts in the open runs, among the runs of one anchor, which stand together in a partition.

    Many anchors are taken at once, up to `at_once` windows and the rest of the last anchor, whose contexts are few.
    """

    def shared(w: Windows) -> np.ndarray:
        """Windows that are there more than once, by both fingerprints."""
        hit = np.arange(len(w.own))
        for which in (0, 1):
            _, back, counts = np.unique(w.of(which, hit), return_inverse=True, return_counts=True)
            hit = hit[counts[back] > 1]
        return hit

    def found(t: pa.Table, powers: Powers) -> Iterator[pa.RecordBatch]:
        for kind, t in by_kind(t):
            k1, k2, lo, hi = (t.column(c).to_numpy() for c in ("k1", "k2", "lo", "hi"))
            w = Windows(t.column("units").to_pylist(), lo, hi, words if kind == IN_WORDS else length, kind, powers)
            hit = shared(w)
            hit = hit[t.column("open").to_numpy()[w.own[hit]]]
            if not len(hit):
                continue
            cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(w.own[hit]) != 0)) + 1
            a, b = hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])]
            own = w.own[a]
            yield places(k1[own], k2[own], kind, lo[own] + w.step[a], lo[own] + w.step[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, powers = [], 0, Powers()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                held.append(batch)
                size += int((batch.column("hi").to_numpy() - batch.column("lo").to_numpy()).sum()) + batch.num_rows
                if size >= at_once:
                    t = pa.Table.from_batches(held).combine_chunks()
                    a = t.column("a").to_numpy()
                    done = int(np.searchsorted(a, a[-1]))  # the last anchor may go on in the next batch
                    yield from found(t.slice(0, done), powers)
                    rest = t.slice(done)
                    held, size = rest.to_batches(), int((rest.column("hi").to_numpy() - rest.column("lo").to_numpy()).sum()) + rest.num_rows
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks(), powers)

    return contexts.repartition("a").sortWithinPartitions("a").mapInArrow(run, PLACES)


CUT = "c1 long, c2 long, s1 long, s2 long, words boolean, k1 long, k2 long, lo long, hi long, open boolean, units binary"


def cut_runs(contexts: DataFrame, length: int, k: int, words: int, word_k: int) -> DataFrame:
    """Every run cut by the windows' distance from the anchor: fingerprints c1, c2 of the core, s1, s2 of the whole stretch."""

    def cut(t: pa.Table, powers: Powers) -> Iterator[pa.RecordBatch]:
        for kind, t in by_kind(t):
            n, gram = (words, word_k) if kind == IN_WORDS else (length, k)
            step = max(2, n // 25)
            k1, k2, lo, hi, a = (t.column(c).to_numpy() for c in ("k1", "k2", "lo", "hi", "a"))
            raw, is_open = t.column("units").to_pylist(), t.column("open").to_numpy()
            w = Windows(raw, lo, hi, n, kind, powers)
            # an anchor is the first gram of a context with its hash
            g = w.hashes.grams(gram)
            context = np.searchsorted(w.begin, np.arange(len(g)), "right") - 1
            there = np.flatnonzero((g ^ a.view(U)[context]) & ~U(1) == 0)
            anchor = there[np.searchsorted(there, w.begin)]
            start = w.begin[w.own] + w.step
            part = (anchor[w.own] - start) // step
            edge = np.flatnonzero((np.diff(part) != 0) | (np.diff(w.own) != 0)) + 1
            x, y = np.concatenate([[0], edge]), np.concatenate([edge - 1, [len(part) - 1]])
            own, low, high = w.own[x], start[x], start[y]
            near = anchor[own] - part[x] * step
            key = a[own].view(U) + part[x].astype(U) * U(BASES[1])
            core = [mix(w.hashes.of(near, near - step + 1 + n, which) + key) for which in (0, 1)]
            stretch = [w.hashes.of(low, high + n, which) for which in (0, 1)]
            size = 8 if kind == IN_WORDS else 1
            units = [raw[o][i * size : j * size] for o, i, j in zip(own.tolist(), w.step[x].tolist(), (w.step[y] + n).tolist(), strict=True)]
            columns = [*(c.view(np.int64) for c in (*core, *stretch)), np.full(len(own), kind == IN_WORDS), k1[own], k2[own], lo[own] + w.step[x], lo[own] + w.step[y], is_open[own]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(units, pa.binary())], names=[c.split()[0] for c in CUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                yield from cut(pa.Table.from_batches([whole.slice(at, 500)]), powers)

    return contexts.mapInArrow(run, CUT)


def resolve_large(contexts: DataFrame, length: int, k: int, words: int, word_k: int) -> DataFrame:
    """The same for anchors with many runs: rank by core, then by stretch, then window by window, each by a shuffle."""
    cuts = materialise(cut_runs(contexts, length, k, words, word_k), "cuts")
    place = F.struct("words", "k1", "k2", "lo", "hi")
    stretches = cuts.groupBy("c1", "c2", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p"))
    cores = stretches.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
    whole = cuts.where("open").join(stretches.where("n > 1").select("c1", "c2", "s1", "s2"), ["c1", "c2", "s1", "s2"], "left_semi").select("k1", "k2", "words", "lo", "hi")
    # a core with one stretch, or with shared ones alone, has nothing left to decide
    undecided = stretches.join(cores.where("m > 1 and least = 1").select("c1", "c2"), ["c1", "c2"], "left_semi").select("p.*", (F.col("n") == 1).alias("alone"))
    rows = cuts.select("words", "k1", "k2", "lo", "hi", "open", "units").join(undecided, ["words", "k1", "k2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, 2000):
                t = pa.Table.from_batches([all_rows.slice(at, 2000)])
                in_word = t.column("words").to_numpy()
                for kind in (IN_BYTES, IN_WORDS):
                    own = t.filter(pa.array(in_word == (kind == IN_WORDS)))
                    if not own.num_rows:
                        continue
                    k1, k2, lo, hi, marked = (own.column(c).to_numpy() for c in ("k1", "k2", "lo", "hi", "marked"))
                    w = Windows(own.column("units").to_pylist(), lo, hi, words if kind == IN_WORDS else length, kind, powers)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w.of(0).view(np.int64), w.of(1).view(np.int64), np.full(len(w.own), kind == IN_WORDS), k1[w.own], k2[w.own], lo[w.own] + w.step, marked[w.own])], names=["h1", "h2", "words", "k1", "k2", "lo", "marked"])

    each = rows.select("words", "k1", "k2", "lo", "hi", (F.col("open") & F.col("alone")).alias("marked"), "units").mapInArrow(run, "h1 long, h2 long, words boolean, k1 long, k2 long, lo long, marked boolean")
    each = materialise(each, "windows")
    shared = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    alone = each.where("marked").join(shared, ["h1", "h2"], "left_semi").select("k1", "k2", "words", "lo", F.col("lo").alias("hi"))
    return whole.unionByName(alone)


def repeated_windows(docs: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP, words: int = WORDS, word_k: int = WORD_K) -> DataFrame:
    """docs(k1, k2, text) -> (k1, k2, ranges array<struct<lo,hi>>, n_shared): the window starts of each text that are repeats.

    ranges counts in bytes; n_shared is how many different strings of `words` words also stand in another row's text.
    """
    every = materialise(find_runs(docs, length, k, words, word_k), "runs")
    counts = materialise(every.groupBy("a").agg(F.count(F.lit(1)).alias("n_a")).where("n_a > 1"), "anchors")
    alive = materialise(join_spread(every, counts.select("a"), "a", "left_semi", counts.where(F.col("n_a") > HOT)), "alive")
    discard(every, counts)

    place = F.struct("k1", "k2", "lo", "hi")
    stretches = materialise(alive.groupBy("a", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p")), "stretches")
    # undecided runs, and one run of each stretch that could match them; an anchor alone with one stretch has nothing to decide
    anchors = stretches.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("a", (F.col("m") > group).alias("large"))
    wanted = join_spread(stretches, anchors, "a", "inner").select("p.k1", "p.k2", F.struct("a", "large", "p.k1", "p.k2", "p.lo", "p.hi", (F.col("n") == 1).alias("open")).alias("run"))
    wanted = materialise(wanted.groupBy("k1", "k2").agg(F.collect_list("run").alias("runs")), "wanted")
    held = among(docs, wanted.select("k1")).join(wanted, ["k1", "k2"]).select("text", "runs")
    contexts = materialise(cut_contexts(held, length, words), "contexts")
    discard(wanted)
    whole = alive.join(stretches.where("n > 1").select("a", "s1", "s2"), ["a", "s1", "s2"], "left_semi").select("k1", "k2", (F.col("a").bitwiseAND(1) == 1).alias("words"), "lo", "hi")
    small = resolve(contexts.where("not large").drop("large"), length, words)
    found = whole.unionByName(small)
    if not contexts.where("large").isEmpty():
        found = found.unionByName(resolve_large(contexts.where("large").drop("large"), length, k, words, word_k))
    ranges = F.array_sort(F.collect_list(F.when(~F.col("words"), F.struct("lo", "hi"))))
    n_shared = F.coalesce(F.sum(F.when(F.col("words"), F.col("hi") - F.col("lo") + 1)), F.lit(0))
    out = materialise(found.distinct().groupBy("k1", "k2").agg(ranges.alias("ranges"), n_shared.alias("n_shared")), "ranges")
    discard(alive, stretches, contexts)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, group: int = GROUP, words: int = WORDS, word_k: int = WORD_K, keep_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_shared[, kept binary]), one row for each row of docs.

    n_shared: different strings of `words` words of the text that stand in another row's text as well; they stay.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).select("id", "text", *fingerprint("text"))
    found = repeated_windows(rows.select("k1", "k2", "text"), length, k, group, words, word_k)
    ranges = found.where("size(ranges) > 0")
    held = among(rows, ranges.select("k1")).join(ranges, ["k1", "k2"]).select("id", "n_shared", "text", "ranges")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out: list[tuple] = []
                for raw, own in zip(raw_texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                    spans: list[list[int]] = []
                    for r in own:
                        if spans and r["lo"] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], r["hi"] + length)
                        else:
                            spans.append([r["lo"], r["hi"] + length])
                    kept, last = [], 0
                    for a, b in spans:
                        kept.append(raw[last:a])
                        last = b
                    kept = b"".join([*kept, raw[last:]])
                    out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 if keep_text else 4]
                columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["id", "n_shared", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 2 + len(columns)])

    schema = f"id {id_type}, n_shared long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    touched = held.mapInArrow(run, schema)
    # the others keep every byte: narrow keys decide which they are
    narrow = rows.select("id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept")] if keep_text else []))
    rest = narrow.join(found.select("k1", "k2", "n_shared", (F.size("ranges") > 0).alias("less")), ["k1", "k2"], "left").where("less is null or not less")
    rest = rest.withColumns({"n_shared": F.coalesce("n_shared", F.lit(0).cast("long")), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long")}).select(*touched.columns)
    every = touched.unionByName(rest).withColumnRenamed("id", id_col)
    return every.select(*[c for c in every.columns if c != "n_shared"], "n_shared")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
