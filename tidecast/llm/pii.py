"""Personal data: fixed forms, and terms that give protected entities away.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. Each value found is a protected entity, and so is
each broader one it belongs to: the domain and the local part of an address, a network of 65,536 addresses, an issuer's six digits, a
country and area code, and the kind itself. So what stands beside values that occur once is judged by what they have in common.

Terms are counted over whole texts, outside base spans: with n(c, t) different texts that hold entity c and term t, n(c) different texts
that hold c, and t in n(t) of N different texts, the pointwise mutual information of t and c is log2(n(c, t) N / (n(c) n(t))), and c
carries log2(N / n(c)) bits. For broader entities, which many terms meet by chance, small counts are shrunk: n(c, t) counts by
n / (n + 1), which takes 0.4 bits of three texts and nothing of many. A term that stands in SUPPORT or more different texts of c and reveals DISCLOSED or more of c's bits
is a span as well, wherever it stands in a text that holds c, at any distance from it. A text without c keeps the term in clear:
what ties the two are texts that hold both, and in each of these both are spans.

A term is a word of two letters or digits or more, lower-cased; Han characters and kana, written without spaces, make a term of
every two neighbours. Offsets are code points, ends exclusive. Null text counts as empty and has no spans; repeated rows give
repeated results, and equal texts count once in all four numbers, so that copies of a text neither make its words telling nor hide
those that are. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import among, apart, discard, fingerprint, free_name, join_spread, materialise, slices, table

KINDS = ("email", "ip", "card", "phone", "term")
#: What a span becomes in the sanitised text.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
SUPPORT, DISCLOSED = 3, 0.9
#: Bits of the filter of candidate terms that goes to the workers, by their number: 64 KB to 2 MB.
FILTER_BITS = (19, 24)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin at the start of a run of digits, which the look-behind says to save the search the rest.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Han and kana, whose words no space parts.
HAN_KANA = "\u3005\u3041-\u3096\u30a1-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TERM = re.compile(rf"[^\W_{HAN_KANA}]{{2,}}|[{HAN_KANA}]{{2,}}")
UNSPACED = re.compile(f"[{HAN_KANA}]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the run of its characters before an @, back to the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ordered."""
    found = [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(int(x) <= 255 if len(x) < 20 else not x.strip("0") or int(x[-20:]) <= 255 and not x[:-20].strip("0") for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def entities_of(kind: int, value: str) -> list[int]:
    """The protected entities of a value as numbers: itself, which is even, and the broader ones, which are odd."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == 0:
        local, _, domain = value.rpartition("@")
        broader = [f"at {domain.lower()}", f"by {local.lower()}"]
    else:
        broader = [{1: "net " + ".".join(value.split(".")[:2]), 2: f"issuer {digits[:6]}", 3: f"area {digits[:4]}"}[kind]]
    return [key(f"{kind}:{value}") & ~1, *(key(c) | 1 for c in (*broader, f"kind {kind}"))]


def gaps(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The stretches of text outside the spans, which are ordered and may overlap."""
    at = 0
    for start, _, end in spans:
        if start > at:
            yield at, start
        at = max(at, end)
    if at < len(text):
        yield at, len(text)


def terms_in(run: str) -> list[tuple[int, int]]:
    """(t, offset) of each term in a match of TERM."""
    if len(run) > 2 and UNSPACED.match(run):
        return [(key(run[k : k + 2]), k) for k in range(len(run) - 1)]
    return [(key(run.lower()), 0)]


def runs_of(text: str) -> set[str]:
    """Different matches of TERM outside the base spans."""
    found = set()
    for low, high in gaps(text, base_spans(text)):
        found.update(TERM.findall(text, low, high))
    return found


def term_places(text: str, telling: set[int]) -> list[tuple[int, int]]:
    """(start, end) of every occurrence of the telling terms outside the base spans."""
    found = []
    for low, high in gaps(text, base_spans(text)):
        for m in TERM.finditer(text, low, high):
            unspaced = len(m[0]) > 2 and UNSPACED.match(m[0])
            found += [(m.start() + k, m.start() + k + 2 if unspaced else m.end()) for t, k in terms_in(m[0]) if t in telling]
    return found


COUNTS = ["n_email", "n_ip", "n_card", "n_phone"]


def keyed_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, text): the fingerprint of each row's text, a null one as empty."""
    return docs.select(F.coalesce(text_col, F.lit("")).alias("text")).select(*fingerprint("text"), "text")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, n_email, n_ip, n_card, n_phone, base_sha256, base, entities), one row for each row of docs.

    k1, k2: fingerprint of the text; entities: a number for each different value found and each broader entity.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, k1 long, k2 long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, entities array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, base, entities = [], [], []
            for text in batch.column(3):
                text = text.as_py() or ""
                spans = base_spans(text)
                counts.append([sum(k == i for _, k, _ in spans) for i in range(4)] if spans else [0, 0, 0, 0])
                base.append(written(spans))
                entities.append(sorted({c for s, k, e in spans for c in entities_of(k, text[s:e])}))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            digests = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, digests, pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.int64()))], names=[id_col, "k1", "k2", *COUNTS, "base_sha256", "base", "entities"])

    return docs.select(id_col, *fingerprint(F.coalesce(text_col, F.lit(""))), text_col).mapInArrow(run, schema)


def different_texts(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(text): every text once. Only those that several rows share are shuffled, once for each task that reads them."""
    copies = materialise(found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("k1"), "copies")
    keyed = keyed_texts(docs, text_col)
    return apart(keyed, copies).select("text").unionByName(among(keyed, copies).groupBy("k1", "k2").agg(F.first("text").alias("text")).select("text"))


def term_counts(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(t, n_t): rows of texts(text) that hold each term, for a superset of the terms in candidates(t).

    The filter of candidates has a bounded size whatever their number, so it may be sent to every worker; workers sum what they see
    before anything is shuffled.
    """
    size = min(max(candidates.count().bit_length() + 3, FILTER_BITS[0]), FILTER_BITS[1])
    words = candidates.select(F.shiftrightunsigned("t", 64 - size).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
    held = np.zeros(1 << (size - 6), np.int64)
    for r in words.collect():  # 2**18 rows at most
        held[r[0]] = r[1]
    sent = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts, known = sent.value.view(np.uint64), Counter(), {}

        def candidate(t: int) -> bool:
            b = (t & ((1 << 64) - 1)) >> (64 - size)
            return bool(int(bits[b >> 6]) >> (b & 63) & 1)

        for batch in slices(batches):
            for text in batch.column(0):
                own = set()
                for word in runs_of(text.as_py() or ""):
                    if word not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[word] = [t for t, _ in terms_in(word) if candidate(t)]
                    own.update(known[word])
                counts.update(own)
            if len(counts) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["t", "n"])
                counts.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["t", "n"])

    return texts.mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t"))


def owned(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(k1, k2, c, n_c): the different texts of each entity that stands in `support` of them or more."""
    each = found.where("size(entities) > 0").select("k1", "k2", F.explode("entities").alias("c")).distinct()
    n_c = each.groupBy("c").agg(F.count(F.lit(1)).alias("n_c")).where(F.col("n_c") >= support)
    return materialise(join_spread(each, n_c, "c", "inner").select("k1", "k2", "c", "n_c"), "owned")


def texts_of(docs: DataFrame, owners: DataFrame, text_col: str = "text") -> DataFrame:
    """(k1, k2, text): the texts of the owners, each once."""
    once = among(keyed_texts(docs, text_col), owners.select("k1")).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    return materialise(once.join(owners.select("k1", "k2").distinct(), ["k1", "k2"]).select("k1", "k2", "text"), "owners")


def telling_terms(docs: DataFrame, found: DataFrame, owners: DataFrame, texts: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """(k1, k2, terms array<long>): for each text of an entity the terms in it that give the entity away, by fingerprint of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            held = [sorted({t for word in runs_of(text.as_py()) for t, _ in terms_in(word)}) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(held, pa.list_(pa.int64()))], names=["k1", "k2", "terms"])

    # a share of `disclosed` needs n_t <= total * (n_c / total) ** disclosed, since n_ct is n_c at most
    total = float(found.select("k1", "k2").distinct().count())
    most = owners.agg(F.max("n_c")).first()[0]
    if not most:
        return docs.sparkSession.createDataFrame([], "k1 long, k2 long, terms array<long>")  # reads nothing that may be removed
    written = materialise(texts.mapInArrow(run, "k1 long, k2 long, terms array<long>"), "terms")
    held = written.select("k1", "k2", F.explode("terms").alias("t"))
    candidates = materialise(held.groupBy("t").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= support), "candidates")

    def rare(n_c):
        return F.col("n_t") <= F.lit(total) * F.pow(n_c / F.lit(total), F.lit(disclosed)) * (1 + 1e-9)

    def share(n_t):
        shrunk = F.when(F.col("c").bitwiseAND(F.lit(1)) == 1, F.col("n_ct") / (F.col("n_ct") + 1)).otherwise(1.0)
        pmi = F.log2(shrunk * F.col("n_ct") * F.lit(total) / (F.col("n_c") * n_t))
        return F.coalesce(pmi / F.nullif(F.log2(F.lit(total) / F.col("n_c")), F.lit(0.0)), F.lit(0.0))

    of_text = owners.groupBy("k1", "k2").agg(F.collect_list(F.struct("c", "n_c")).alias("cs"))
    # a term stands in m texts or more, so its share with n_t = m is the most that it can be: nearly all terms fall here
    with_entities = written.join(of_text, ["k1", "k2"]).select(F.explode("cs").alias("e"), "terms").select("e.c", "e.n_c", F.explode("terms").alias("t"))
    together = with_entities.groupBy("c", "n_c", "t").agg(F.count(F.lit(1)).alias("n_ct")).where(F.col("n_ct") >= support)
    likely = materialise(together.join(candidates, "t").where(share(F.col("m")) >= disclosed * (1 - 1e-9)).groupBy("t").agg(F.first("m").alias("m")), "likely")
    counts = materialise(term_counts(different_texts(docs, found, text_col), likely).join(likely, "t").where(rare(F.lit(float(most)))).select("t", "n_t"), "counts")
    # common terms, which are most of a text, leave before anything is shuffled
    rows = among(held.select(F.col("k1").alias("o1"), "k2", F.col("t").alias("k1")), counts.select(F.col("t").alias("k1")))
    places = join_spread(rows.select("o1", "k2", F.col("k1").alias("t")), counts, "t", "inner")
    by_text = places.groupBy(F.col("o1").alias("k1"), "k2").agg(F.collect_list(F.struct("t", "n_t")).alias("ts"))
    met = materialise(by_text.join(of_text, ["k1", "k2"]), "met")
    pairs = met.select("k1", "k2", F.explode("cs").alias("e"), "ts").select("k1", "k2", "e.c", "e.n_c", F.explode("ts").alias("w")).select("k1", "k2", "c", "n_c", "w.t", "w.n_t").where(rare(F.col("n_c")))
    n = pairs.groupBy("c", "t", "n_c", "n_t").agg(F.count(F.lit(1)).alias("n_ct")).where(F.col("n_ct") >= support)
    telling = materialise(n.where(share(F.col("n_t")) >= disclosed).select(F.xxhash64("c", "t").alias("k1"), F.col("c").alias("own_c"), F.col("t").alias("own_t")), "disclosing")
    hits = among(pairs.select(F.col("k1").alias("o1"), "k2", "c", "t", F.xxhash64("c", "t").alias("k1")), telling)
    hits = join_spread(hits, telling, "k1", "inner").where("c = own_c and t = own_t")
    terms = materialise(hits.groupBy(F.col("o1").alias("k1"), "k2").agg(F.collect_set("t").alias("terms")), "telling")
    discard(written, candidates, likely, counts, met, telling)
    return terms


def term_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(k1, k2, terms array<struct<s,e>>): every place of the telling terms, by fingerprint of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            places = [[{"s": s, "e": e} for s, e in term_places(text.as_py(), set(own.as_py()))] for text, own in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(places, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], names=["k1", "k2", "terms"])

    return texts.join(terms, ["k1", "k2"]).select("k1", "k2", "text", "terms").mapInArrow(run, "k1 long, k2 long, terms array<struct<s:long,e:long>>")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans), one row for each row of docs; n_spans counts all spans."""
    found = materialise(detect(docs, id_col, text_col), "pii")
    owners = owned(found, support)
    texts = texts_of(docs, owners, text_col)
    terms = materialise(term_spans(texts, telling_terms(docs, found, owners, texts, text_col, support, disclosed)), "places")
    as_text = F.transform("terms", lambda p: F.concat(F.lit("term:"), p["s"], F.lit(":"), p["e"]))
    # spans are ordered by start, then kind as listed; terms don't overlap base spans, so starts decide
    every = F.filter(F.concat(F.split("base", ","), F.coalesce(as_text, F.array().cast("array<string>"))), lambda s: s != "")
    ordered = F.array_join(F.transform(F.array_sort(F.transform(every, lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("at"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).alias("kind"), s.alias("s")))), lambda x: x["s"]), ",")
    out, n_spans = [id_col, *COUNTS, "base_sha256"], F.size(every).cast("long").alias("n_spans")
    # texts without an entity have no such terms, and copies of them needn't meet in a task
    return found.where("size(entities) = 0").select(*out, F.col("base").alias("spans"), F.lit(0).cast("long").alias("n_spans")).unionByName(found.where("size(entities) > 0").join(terms, ["k1", "k2"], "left").select(*out, ordered.alias("spans"), n_spans))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """docs with every span of the text replaced by its mask; other columns stay. A null text stays null."""
    found = materialise(detect(docs, id_col, text_col), "pii")
    owners = owned(found, support)
    texts = texts_of(docs, owners, text_col)
    terms = telling_terms(docs, found, owners, texts, text_col, support, disclosed)
    discard(found, owners, texts)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *fingerprint(F.coalesce(text_col, F.lit(""))))
    own = free_name("terms", docs.columns)
    # only texts that may hold a telling term are shuffled
    met = among(keyed, terms.select("k1")).join(terms, ["k1", "k2"], "left").select("row.*", F.col("terms").alias(own))
    marked = apart(keyed, terms.select("k1")).select("row.*", F.lit(None).cast(terms.schema["terms"].dataType).alias(own)).unionByName(met)
    where = docs.columns.index(text_col)

    def clean(text: str | None, terms: list | None) -> str | None:
        if text is None:
            return None
        spans = base_spans(text)
        if terms:
            spans = sorted(spans + [(s, 4, e) for s, e in term_places(text, set(terms))])
        out, last = [], 0
        for s, k, e in spans:
            if e <= last:
                continue
            if s >= last:
                out += [text[last:s], MASKS[KINDS[k]]]
            last = e  # what overlaps an earlier span goes with it
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [clean(t.as_py(), p.as_py()) for t, p in zip(batch.column(where), batch.column(batch.num_columns - 1), strict=True)]
            columns = [pa.array(texts, batch.schema.field(where).type) if k == where else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return marked.mapInArrow(run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"))
