"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased (A-Z) and reduced to words with single spaces. An item of m bytes may differ from a
passage by EDITS * m edits. Then the two share at least m + 1 - q - q * edits q-grams, and those lie on diagonals at most `edits`
apart. So shared q-grams are counted in overlapping bands of diagonals, bands with enough of them are kept, and banded
alignment of the whole item decides each. Items too short for the lemma have fewer edits, down to none: an item under Q bytes is
looked up as it is, between spaces, with a `shared` of 0, and is no evidence by itself, as it may be a common word. Passages of one
item that overlap by most of it are one passage.

The benchmark goes to the workers in blocks of about BLOCK_BYTES of text, one pass over the documents for each. A block's index is
built once, in the driver, and sent; it takes some 25 times its text, there and in a worker, and only one is about at a time. Several
blocks write the hits of each. Where a text shares very many q-grams with a block, as common words do, hashed counts of bands, which
are never too low, leave out nearly all of them before bands are counted as they are. Null or
empty texts and items match nothing; repeated rows give repeated results; repeated items are reported each, and an item without
item_id with a null one; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import among, apart, fingerprint, materialise, slices, table
from tidecast.llm.licenses import FOLD

Q, EDITS, BLOCK_BYTES = 8, 0.1, 4 << 20
#: Places of the filter and of the table of an index for each of its q-grams, at least.
FILTERED, TABLED = 16, 1
#: q-grams shared with a block that are looked at together, and bits of the hashed counts of their bands.
SHARED, BAND_BITS = 1 << 20, (12, 22)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Added to diagonals, which may be negative.
SHIFT = 1 << 24
HITS = "array<struct<item_id:long,start:long,end:long,edits:long,shared:long>>"


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(FOLD).split())


def grams(data: bytes) -> np.ndarray:
    """Every eight bytes of data in a row as one unsigned number."""
    n = len(data) - Q + 1
    return np.ndarray((n,), "<u8", data, strides=(1,)).copy() if n > 0 else np.zeros(0, "<u8")


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, limit: int) -> tuple[int, int]:
    """Least edits of the whole item against a stretch of text on diagonals low..high (text index less item index), and its end.

    Stops with limit + 1 edits as soon as no alignment can be within the limit. Outside the text stands a character that is
    equal to none: to use it costs as much as to drop a character of the item.
    """
    width, m = high - low + 1, len(item)
    before, after = max(0, -low), max(0, high + m - len(text))
    padded = np.concatenate([np.full(before, -1), text, np.full(after, -1)])
    steps, row, at = np.arange(width), np.zeros(width, np.int64), low + before
    for i in range(m):
        new = row + (padded[at + i : at + i + width] != item[i])
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - steps) + steps
        if i & 7 == 7 and row.min() > limit:
            return limit + 1, -1
    best = int(row.argmin())
    return int(row[best]), min(len(text), max(0, low + best + m))


def backwards(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits of the whole item against a prefix of text, and the length of that prefix."""
    steps, row = np.arange(len(text) + 1), np.arange(len(text) + 1)
    for i, c in enumerate(item):
        new = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (text != c))])
        row = np.minimum.accumulate(new - steps) + steps
    best = int(row.argmin())
    return int(row[best]), best


class Index:
    """q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        kept = [(i, n) for i, t in items if (n := normal(t))]
        self.ids, self.texts = [i for i, _ in kept], [n for _, n in kept]
        lengths = np.array([len(n) for n in self.texts], np.int64)
        self.edits = np.maximum(0, np.minimum((lengths * edits).astype(np.int64), (lengths - Q) // Q))
        self.needs = lengths + 1 - Q - Q * self.edits
        self.short = [k for k, n in enumerate(self.texts) if len(n) < Q]
        codes = [grams(n) for n in self.texts]
        every = (np.concatenate(codes) if codes else np.zeros(0, "<u8")) * MIX  # even, and no two become equal
        item = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])
        at = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes]) if codes else np.zeros(0, np.int32)
        order = np.argsort(every, kind="stable")
        self.item, self.at = item[order], at[order]
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every)).astype(np.int32)
        bits = lambda each: max(10, (len(self.keys) * each).bit_length())
        self.filter_shift, self.table_shift = np.uint64(64 - bits(FILTERED)), np.uint64(64 - bits(TABLED))
        seen = np.zeros(1 << bits(FILTERED), bool)
        seen[self.keys >> self.filter_shift] = True
        self.seen = np.packbits(seen, bitorder="little")
        # keys are in order, so those of a place of the table are neighbours
        self.table = np.searchsorted(self.keys >> self.table_shift, np.arange((1 << bits(TABLED)) + 1, dtype=np.uint64)).astype(np.int32)

    def looked_up(self, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `mixed` keys of the index stand, in order, and which."""
        place = mixed >> self.filter_shift
        at = np.flatnonzero(self.seen[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
        wanted = mixed[at]
        place = (wanted >> self.table_shift).astype(np.int64)
        k, end = self.table[place], self.table[place + 1]
        todo = np.flatnonzero((k < end) & (self.keys[np.minimum(k, len(self.keys) - 1)] != wanted)) if len(self.keys) else np.zeros(0, np.int64)
        while len(todo):
            k[todo] += 1
            todo = todo[k[todo] < end[todo]]
            todo = todo[self.keys[k[todo]] != wanted[todo]]
        real = k < end
        return at[real], k[real]

    def shared(self, at: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, band) of every q-gram of the items that equals key k at position `at` of a text, SHARED of them or so at once."""
        many = (self.first[k + 1] - self.first[k]).astype(np.int64)
        ends = np.cumsum(many)
        low = 0
        while low < len(k):
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + SHARED, "right")))
            n = many[low:high]
            entry = np.arange(int(ends[high - 1]) - before) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k[low:high]], n)
            item = self.item[entry].astype(np.int64)
            yield item, (np.repeat(at[low:high], n) - self.at[entry] + SHIFT) // (self.edits[item] + 1)
            low = high

    def bands(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item, least diagonal, shared q-grams) of each pair of neighbouring bands with enough of the item's q-grams."""
        at, k = self.looked_up(grams(text) * MIX)
        total = int((self.first[k + 1] - self.first[k]).sum(dtype=np.int64))
        if not total:
            return []
        bits = min(max(total.bit_length(), BAND_BITS[0]), BAND_BITS[1])
        mask = (1 << bits) - 1
        # neighbouring bands of an item have neighbouring places
        place = lambda item, band: ((item.astype(np.uint64) * MIX >> np.uint64(20)).astype(np.int64) + band) & mask
        most = np.zeros(mask + 1, np.int64)
        held = None
        for item, band in self.shared(at, k):
            slot = place(item, band)
            most += np.bincount(slot, minlength=mask + 1)
            held = [(item, band, slot)] if len(item) == total else None  # most texts are looked at in one go
        most += np.maximum(np.roll(most, 1), np.roll(most, -1))
        found = []
        for item, band, slot in held or ((i, b, place(i, b)) for i, b in self.shared(at, k)):
            may = most[slot] >= self.needs[item]
            found.append(item[may] * (1 << 40) + band[may])
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        if not len(keys):
            return []
        upper = np.minimum(np.searchsorted(keys, keys + 1), len(keys) - 1)
        both = counts + np.where(keys[upper] == keys + 1, counts[upper], 0)
        own = keys >> 40
        good = both >= self.needs[own]
        return [(int(i), int((b & ((1 << 40) - 1)) * (self.edits[i] + 1) - SHIFT), int(c)) for i, b, c in zip(own[good], keys[good], both[good], strict=True)]

    def hits(self, raw: str | None) -> list[dict]:
        """Passages of raw that are items within their edits: item_id, start and end in the normal form, edits, shared q-grams."""
        text, found = normal(raw), []
        if not text:
            return found
        data, taken = np.frombuffer(text, np.uint8).astype(np.int64), {}
        for i, low, shared in self.bands(text):
            item, wide = self.texts[i], int(self.edits[i]) + 1
            if i in taken and low <= taken[i] + wide:  # bands of an item come in ascending order
                continue
            m = len(item)
            start = text.find(item, max(0, low), max(0, low) + m + 2 * wide)
            if start >= 0:
                edits, end = 0, start + m
            else:
                own, most = np.frombuffer(item, np.uint8).astype(np.int64), int(self.edits[i])
                left, right = low - most, low + 2 * wide - 1 + most  # parts without a shared q-gram may lie beyond the bands
                begin = max(0, left)
                edits, end = aligned(own, data[begin : max(0, right + m)], left - begin, right - begin, most)
                if edits > most:
                    continue
                end += begin
                back = data[max(0, end - m - wide) : end][::-1]
                _, length = backwards(own[::-1], back)
                start = max(0, end - length)
            taken[i] = low
            found.append({"item_id": self.ids[i], "start": start, "end": end, "edits": edits, "shared": shared})
        spaced = b" " + text + b" " if self.short else b""
        for i in self.short:
            word = b" " + self.texts[i] + b" "
            start = spaced.find(word)
            while start >= 0:
                found.append({"item_id": self.ids[i], "start": start, "end": start + len(self.texts[i]), "edits": 0, "shared": 0})
                start = spaced.find(word, start + 1)
        return found


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", edits: float = EDITS, block_bytes: int = BLOCK_BYTES, hits_col: str = "hits") -> DataFrame:
    """docs with a column of every benchmark passage in the text. A column that has its name is an error."""
    if hits_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs have a column {hits_col}")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))

    def block(k: int) -> list[tuple]:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about block_bytes
        return sorted(((r[0], r[1]) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    if blocks == 1:
        return scan_block(docs, block(0), edits, text_col, hits_col, everything=True)[0]
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *fingerprint(F.coalesce(text_col, F.lit(""))), F.col(text_col).alias("text"))
    found = None
    for k in range(blocks):
        hits, sent = scan_block(keyed.select("k1", "k2", "text"), block(k), edits, "text", "hits", everything=False)
        part = materialise(hits.groupBy("k1", "k2").agg(F.first("hits").alias("hits")), "hits")  # copies have equal hits
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    found = materialise(found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("hits")).alias("hits")), "hits")
    # only texts that may hold a passage are shuffled
    met = among(keyed, found).join(found, ["k1", "k2"], "left").select("row.*", F.coalesce("hits", F.array().cast(HITS)).alias(hits_col))
    return apart(keyed, found).select("row.*", F.array().cast(HITS).alias(hits_col)).unionByName(met)


def scan_block(docs: DataFrame, items: list[tuple], edits: float, text_col: str, hits_col: str, everything: bool) -> tuple[DataFrame, Broadcast]:
    """docs with their hits of one block's items (without the text and rows that have none, unless everything is wanted), and what was sent."""
    held = docs.sparkSession.sparkContext.broadcast(Index(items, edits))
    where = docs.columns.index(text_col)
    keep = [k for k in range(len(docs.columns)) if everything or k != where]
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "end", "edits", "shared")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in slices(batches):
            found = pa.array([index.hits(text.as_py()) for text in batch.column(where)], kind)
            out = pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), found], names=[*(batch.schema.names[k] for k in keep), hits_col])
            yield out if everything else out.filter(pc.greater(pc.list_value_length(found), 0))

    fields = [f"`{docs.columns[k]}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    return docs.mapInArrow(run, ", ".join([*fields, f"`{hits_col}` {HITS}"])), held


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_hits(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
