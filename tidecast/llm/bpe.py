"""Byte-level BPE: encoding and decoding of whole texts by the ranks of a public vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is itself an entry. The others are merged
byte by byte: neighbours form a linked list, a heap yields the pair of least rank (leftmost first), and stale heap entries are
skipped; words of a few bytes, for which a heap costs more than it saves, look for that pair
in a list of ranks. Both tiers sit behind a bounded cache, kept by a Python process from task to task, which changes no result.

Null text counts as empty, an empty text gives no ids, repeated rows give repeated results, and other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tidecast.llm.common import slices, table

#: Entries of a worker's cache of pre-tokens before it is set aside and a new one begun; what comes up again moves over.
CACHE = 100_000
MASK = (1 << 64) - 1
#: Bytes of a pre-token up to which pairs are looked for in a list instead of a heap, and a rank above all.
SHORT, NO_RANK = 32, 1 << 32
ONE = [bytes([b]) for b in range(256)]
#: Refused above this, as the vocabulary is sent to every worker.
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash by hashing and displacing: n keys in n slots, with one small number for each bucket of about two keys."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        hashed = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashed):
            members[h % self.buckets].append(i)
        self.displace, slots = [0] * self.buckets, [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        free = iter(range(n))
        for b in order:
            own = members[b]
            if not own:
                break
            if len(own) == 1:  # straight into the next free slot
                slot = next(s for s in free if slots[s] < 0)
                slots[slot], self.displace[b] = own[0], -slot - 1
                continue
            d = 0
            while True:
                at = [self.place(hashed[i], d) for i in own]
                if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                    break
                d += 1
            self.displace[b] = d
            for s, i in zip(at, own, strict=True):
                slots[s] = i
        self.slots = slots

    def place(self, h: int, d: int) -> int:
        x = ((h >> 17) ^ (h << 13) & MASK) + d * 0x9E3779B97F4A7C15 & MASK
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & MASK
        return (x ^ x >> 29) % self.n

    def slot(self, key: bytes) -> int:
        """The only index that key can have among the keys; the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.buckets]
        return self.slots[-d - 1 if d < 0 else self.place(h, d)]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if sum(map(len, ranks)) > MAX_VOCABULARY_BYTES:
            raise ValueError("the vocabulary is too large to send to every worker")
        self.keys, self.ids = list(ranks), list(ranks.values())
        self.hash, self.pattern, self.worker = PerfectHash(self.keys), pattern, None

    def ready(self) -> "Worker":
        """This process's worker; it isn't sent anywhere."""
        if self.worker is None:
            self.worker = Worker(self)
        return self.worker

    def __getstate__(self) -> dict:
        return self.__dict__ | {"worker": None}


class Worker(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers, filled as pre-tokens come up."""

    def __init__(self, codec: Codec):
        self.codec, self.split = codec, regex.compile(codec.pattern).findall
        self.ranks = dict(zip(codec.keys, codec.ids, strict=True))
        self.bytes_of = {i: k for k, i in self.ranks.items()}
        self.two = {tuple(k): i for k, i in self.ranks.items() if len(k) == 2}
        self.older: dict[str, bytes] = {}

    def __missing__(self, token: str) -> bytes:
        found = self.older.get(token)
        if found is None:
            raw, codec = token.encode("utf-8", "surrogatepass"), self.codec
            at = codec.hash.slot(raw)
            ids = [codec.ids[at]] if codec.keys[at] == raw else merge(raw, self.ranks, self.two)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(raw) > 256:
                return found
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[token] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def merge(raw: bytes, ranks: dict[bytes, int], two: dict[tuple[int, int], int]) -> list[int]:
    """Ids of raw after merging the pair of least rank, leftmost first, until no pair is an entry. two: the entries of two bytes."""
    n = len(raw)
    if n < 2:
        return [ranks[raw]] if n else []
    return merge_short(raw, ranks, two) if n <= SHORT else merge_by_heap(raw, ranks)


def merge_short(raw: bytes, ranks: dict[bytes, int], two: dict[tuple[int, int], int]) -> list[int]:
    """merge for two bytes and more: in time square in their number, with little work a merge."""
    get, parts = ranks.get, list(map(ONE.__getitem__, raw))
    pairs = list(map(two.get, zip(raw, raw[1:]), repeat(NO_RANK)))  # noqa: B905
    while pairs and (least := min(pairs)) < NO_RANK:
        i = pairs.index(least)
        whole = parts[i] + parts.pop(i + 1)
        parts[i] = whole
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(whole + parts[i + 1], NO_RANK)
        if i:
            pairs[i - 1] = get(parts[i - 1] + whole, NO_RANK)
    return [ranks[part] for part in parts]


def merge_by_heap(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge for two bytes and more: for long ones."""
    n = len(raw)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or not end[i] or end[j] != stop:
            continue  # one of the two has been merged meanwhile
        end[i], end[j] = stop, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(raw[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(raw[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    found, i = [], 0
    while i < n:
        found.append(ranks[raw[i : end[i]]])
        i = after[i]
    return found


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256[, ids binary, decoded string]), one for each row of docs.

    ids holds little-endian unsigned 32-bit integers; decoded is read back from them.
    """
    codec = docs.sparkSession.sparkContext.broadcast(Codec(ranks, pattern))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec.value.ready()
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                ids = worker.encode(text.as_py() or "")
                decoded = worker.decode(ids)
                for column, x in zip(out, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *(ids, decoded) * keep_ids), strict=False):
                    column.append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())[: 5 if keep_ids else 3]
            columns = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=False)]
            if keep_ids:
                columns[4] = pa.array([x.decode("utf-8", "replace") for x in out[4]], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 1 + len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False)
