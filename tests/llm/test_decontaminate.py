import random

import pytest

from tidecast.llm import decontaminate as d


def least_edits(item: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edit(rng, item: str, n: int) -> str:
    out = list(item)
    for _ in range(n):
        k, at = rng.randrange(3), rng.randrange(1, len(out) - 1)
        if k == 0:
            out[at] = "q"
        elif k == 1:
            del out[at]
        else:
            out.insert(at, "z")
    return "".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeinorstlh") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randrange(1, 40))) for i in range(12)] + [(12, "ab"), (13, ""), (14, None)]
    docs = []
    for k in range(60):
        parts = [text(rng.randrange(0, 60))]
        if k % 3:
            item = items[rng.randrange(12)][1]
            parts.append(edit(rng, item, rng.randrange(0, 2 + len(item) // 8)) if len(item) > 4 and k % 2 else item.upper())
        docs.append(" ".join([*parts, text(rng.randrange(0, 60))]))
    return items, [*docs, "", None, items[0][1] + "... " + items[0][1], "x ab y"]


def test_every_item_within_its_edits_is_found_and_no_other(corpus):
    items, docs = corpus
    index = d.Index([(i, t) for i, t in items if t is not None])
    for text in docs:
        found = {h["item_id"]: h for h in index.hits(text)}
        plain = d.normal(text)
        for i, item, most in zip(index.ids, index.texts, index.edits, strict=True):
            if len(item) < d.Q:
                assert (i in found) == ((b" " + item + b" ") in (b" " + plain + b" "))
            else:
                assert (i in found) == (least_edits(item, plain) <= most), (i, text)
                if i in found:
                    h = found[i]
                    assert least_edits(item, plain[h["start"] : h["end"]]) <= most


def test_blocks_of_the_benchmark_give_the_same(spark, corpus):
    items, docs = corpus
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    rows = lambda **o: sorted((r[0], sorted(h["item_id"] for h in r[1])) for r in d.with_hits(frame.unionByName(frame), bench, hits_col="found", **o).select("doc_id", "found").collect())
    assert rows() == rows(block_bytes=200) and len(rows()) == 2 * len(docs)
    with pytest.raises(ValueError):
        d.with_hits(frame, bench)
    assert any(h for _, h in rows())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.with_hits(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    assert [r["hits"] for r in d.with_hits(one, bench).collect()] == [[], []]


def test_items_without_an_id_are_reported_too(spark):
    item = "which of these rivers is the longest in the old kingdom"
    docs = spark.createDataFrame([(1, "We ask: " + item + "?"), (2, "nothing of the kind stands here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (7, item), (None, None)], "item_id long, text string")
    got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in d.with_hits(docs, bench).collect()}
    assert sorted(got[1], key=str) == [7, None] and got[2] == []


def plain_bands(index: d.Index, text: bytes) -> list[tuple[int, int, int]]:
    """Bands counted one q-gram at a time."""
    counts = {}
    places = {}
    for i, item in enumerate(index.texts):
        for p in range(len(item) - d.Q + 1):
            places.setdefault(item[p : p + d.Q], []).append((i, p))
    for at in range(len(text) - d.Q + 1):
        for i, p in places.get(text[at : at + d.Q], []):
            band = (i, (at - p + d.SHIFT) // (int(index.edits[i]) + 1))
            counts[band] = counts.get(band, 0) + 1
    both = {(i, b): n + counts.get((i, b + 1), 0) for (i, b), n in counts.items()}
    return [(i, b * (int(index.edits[i]) + 1) - d.SHIFT, n) for (i, b), n in sorted(both.items()) if n >= index.needs[i]]


@pytest.mark.parametrize("shared", [1, 50, 1 << 20])
def test_bands_of_common_words_equal_a_plain_count(monkeypatch, shared):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 10))) for _ in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    index = d.Index([(k, text(rng.randrange(2, 30))) for k in range(40)])
    monkeypatch.setattr(d, "SHARED", shared)
    monkeypatch.setattr(d, "BAND_BITS", (4, 8))  # many bands meet in a place
    for n in (0, 1, 5, 60, 300):
        plain = d.normal(text(n) + " " + (index.texts[n % 40].decode() if n > 4 else ""))
        assert index.bands(plain) == plain_bands(index, plain)


def test_a_full_block_costs_little_more_than_its_hits(spark):
    """Documents and 2 MB of items from the same words: the filter and the hashed counts leave the planted items alone."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 10))) for _ in range(20_000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(20)) for k in range(15_000)]
    index = d.Index(items)
    assert 8 * len(index.seen) >= d.FILTERED * len(index.keys)
    docs = [(k, text(200) + " " + (items[7 * k][1] if k % 2 else "")) for k in range(200)]
    got = d.with_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "hits").collect()
    assert {r[0]: [h["item_id"] for h in r[1]] for r in got} == {k: [7 * k] if k % 2 else [] for k in range(200)}
