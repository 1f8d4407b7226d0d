"""WARC archives of pages: written by Spark, one gzip member for each record, and read back sequentially.

Writing. Spark's text sink puts the bytes of each record and a separator into the files of the shared folder, on any store it
knows. The separator is one zero byte, and a gzip member ends in the highest byte of its length modulo 2**32, which is zero for
records under 16 MB: that byte is left to the sink, so that the file is a plain row of gzip members. A longer record is followed
by an empty member, whose last byte is zero as well.

Files are closed by bytes: a row of the sink is a run of members of ROW_BYTES or little more, and a file has ROWS of them, so that
a file has at most ROWS times what a row and one record take.

Reading. A file is inflated step by step with one zlib object for each member; the header ends at the blank line, the block is
framed by Content-Length and hashed as it comes, and a row leaves when its member ends. Archives of others are read as well: WARC/1.0
and 1.1, every type of record, folded header lines, ids of any form. Digests are optional; those that are there are verified, in
hex or Base32, where their algorithm is known (md5, sha1, sha256, sha512). A payload is what follows the HTTP header, as it was
sent, or the whole block where there is none.

Of pages with equal payloads of at least LEAST bytes, the one with the largest page_id is a response and the others revisit it;
rows that share that page_id are all responses. Null html counts as empty; a null page_id is a response whose id reads back as
null; repeated rows give repeated records; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import among, apart, discard, fresh_path, join_spread, materialise, table

LEAST = 1000
#: Bytes of a run of members, and such runs in a file: some 32 MB, which bounds what a reader task holds.
ROW_BYTES, ROWS = 8 << 20, 4
STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, length: int | None = None) -> bytes:
    """A WARC/1.1 record. A revisit carries the HTTP header only, with the length of the payload of the record it refers to."""
    length = len(payload) if length is None else length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"), f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as a gzip member (or two) whose last byte is zero."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = squeeze.compress(data) + squeeze.flush()
    if out[-1]:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += squeeze.flush()
    return out


KNOWN = ("md5", "sha1", "sha256", "sha512")


class Digest:
    """A digest as a header gives it (algorithm:value, hex or Base32), to be compared with what comes; of unknown algorithms nothing is."""

    def __init__(self, given: str | None):
        name, _, value = (given or "").partition(":")
        name = name.strip().lower().replace("-", "")
        self.hash, self.expected = (hashlib.new(name), None) if name in KNOWN and value else (None, None)
        if self.hash:
            value, size = value.strip(), self.hash.digest_size
            try:
                self.expected = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
            except ValueError:
                self.expected = b""

    def update(self, data: bytes) -> None:
        if self.hash:
            self.hash.update(data)

    def wrong(self) -> bool:
        return self.hash is not None and self.hash.digest() != self.expected


class Record:
    """One record, fed with the inflated bytes of its member: header, digests and lengths; the payload only if it is to be kept."""

    def __init__(self, keep: bool):
        self.keep, self.raw, self.head, self.left = keep, bytearray(), None, 0
        self.http, self.payload, self.tail = bytearray(), [], bytearray()
        self.sha1, self.size, self.in_payload = hashlib.sha1(), 0, False

    def feed(self, data: bytes) -> None:
        if self.head is None:
            self.raw += data
            head, blank, data = bytes(self.raw).partition(b"\r\n\r\n")
            if not blank:
                return
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")
            if lines[0] not in ("WARC/1.0", "WARC/1.1"):
                raise ValueError("not a WARC record")
            whole: list[str] = []
            for line in lines[1:]:
                if line[:1] in (" ", "\t") and whole:
                    whole[-1] += " " + line.strip()
                else:
                    whole.append(line)
            self.head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in whole)}
            self.left, self.raw = int(self.head["content-length"]), bytearray()
            self.of_block, self.of_payload = Digest(self.head.get("warc-block-digest")), Digest(self.head.get("warc-payload-digest"))
            self.in_payload = not self.head.get("content-type", "").lower().startswith("application/http")
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.of_block.update(block)
        if not self.in_payload:
            self.http += block
            http, blank, block = bytes(self.http).partition(b"\r\n\r\n")
            if blank:
                self.http, self.in_payload = bytearray(http), True
            else:
                block = b""
        if self.in_payload:
            self.of_payload.update(block)
            self.sha1.update(block)
            self.size += len(block)
            if self.keep:
                self.payload.append(block)
        self.tail += rest

    def done(self) -> bool:
        """Whether there was a record (an empty member has none); raises ValueError where framing or a digest is wrong."""
        if self.head is None:
            if self.raw:
                raise ValueError("not a WARC record")
            return False
        if self.left or self.tail != b"\r\n\r\n":
            raise ValueError("the block doesn't end where Content-Length says")
        if self.of_block.wrong():
            raise ValueError("the block's digest is wrong")
        if self.kind() != "revisit" and self.of_payload.wrong():
            raise ValueError("the payload's digest is wrong")
        return True

    def kind(self) -> str:
        return self.head.get("warc-type", "").lower()

    def sent(self) -> int | None:
        """Bytes of the payload: as counted, for a revisit as its HTTP header says."""
        if self.kind() != "revisit":
            return self.size
        length = bytes(self.http).decode("latin-1").lower().rpartition("\ncontent-length:")[2].split("\r")[0].strip() if b"\n" in self.http else ""
        return int(length) if length.isdigit() else None

    def digest(self) -> str | None:
        """SHA-1 of the payload in hex; for a revisit as its header says."""
        if self.kind() != "revisit":
            return self.sha1.hexdigest()
        given = self.of_payload
        return given.expected.hex() if given.hash is not None and given.hash.name == "sha1" and given.expected else None


def read_records(data: bytes, keep: bool = False) -> Iterator[Record]:
    """The records of an archive, one gzip member each, one after the other."""
    at, view = 0, memoryview(data)
    while at < len(view):
        inflate, record = zlib.decompressobj(31), Record(keep)
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a gzip member")
            piece = view[at : at + STEP]
            record.feed(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        if record.done():
            yield record


def write_archives(pages: DataFrame, path: str, least: int = LEAST, row_bytes: int = ROW_BYTES, rows: int = ROWS) -> None:
    """Writes a record for every row of pages (page_id, url, html) below path.

    Which rows are revisits is found on narrow rows, without html, and revisits are written from those. Of the wide rows only
    those are shuffled that may be revisits by a filter of fixed size; they meet the revisits by digest and page_id.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    wide = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha1(html).alias("digest"))
    narrow = wide.where(F.col("page_id").isNotNull() & (F.col("n") >= least)).select("page_id", "url", "n", "digest")
    # a null page_id stays a response: it can neither be the largest nor name itself in a revisit
    first = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least_id")).where("least_id < refers_to").select("digest", "refers_to")
    revisits = materialise(join_spread(narrow, first, "digest", "inner").where("page_id < refers_to"), "revisits")
    named = revisits.select(F.col("digest").alias("d"), F.col("page_id").alias("i")).distinct().withColumn("k1", F.xxhash64("d", "i"))
    keyed = wide.withColumn("k1", F.xxhash64("digest", "page_id"))
    met = among(keyed, named).join(named.select("d", "i"), (F.col("digest") == F.col("d")) & (F.col("page_id") == F.col("i")), "left_anti")
    columns = ["page_id", "url", "html", "n", "digest", "refers_to"]
    responses = apart(keyed, named).unionByName(met).withColumn("refers_to", F.lit(None).cast("long"))
    marked = responses.select(*columns).unionByName(revisits.withColumn("html", F.lit(None).cast("binary")).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100).to_pydict()
                for i, url, html, n, digest, to in zip(*(part[c] for c in columns), strict=True):
                    held.append(member(record_bytes(i, url, html or b"", digest, to, n)))
                    size += len(held[-1])
                    if size >= row_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["record"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["record"])

    packed = marked.mapInArrow(run, "record binary")
    packed.select(F.col("record").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", rows).text(path)
    discard(revisits)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id[, payload]) from all archives below path.

    page_id and refers_to are numbers where the ids are of our own form, else null. payload is null for a revisit.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def number(text: str | None) -> int | None:
        digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits.removeprefix("-").isdigit() else None

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for record in read_records(content.as_buffer(), payloads):
                    head, kind = record.head, record.kind()
                    row = (number(head.get("warc-record-id")), head.get("warc-target-uri"), record.sent(), record.digest(), kind, number(head.get("warc-refers-to")), head.get("warc-record-id"))
                    out.append((*row, b"".join(record.payload) if kind != "revisit" else None) if payloads else row)
                    size += 200 + record.size * payloads
                    if size > 1 << 20:
                        yield rows(out)
                        out, size = [], 0
                if out:
                    yield rows(out)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("url", "record_id")


OP10_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS first_id FROM d WHERE payload_bytes >= {LEAST} GROUP BY payload_digest HAVING count(*) > 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN m.first_id > d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.first_id > d.page_id THEN m.first_id END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""
