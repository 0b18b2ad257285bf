import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdica.llm import op3_string_tiling as op

from invented import words


def brute_tiles(doc, item, least):
    """Greedy string tiling by its definition."""
    used_d, used_i, covered, count = set(), set(), 0, 0
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in used_d and b + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return covered, count
        used_d |= set(range(a, a + n))
        used_i |= set(range(b, b + n))
        covered, count = covered + n, count + 1


def tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def brute(docs, items, least=4, threshold=0.5):
    out = {}
    for i, t in docs:
        for j, s in items:
            item = tokens(s)
            if i is None or len(item) < least:
                continue
            covered, count = brute_tiles(tokens(t), item, least)
            if covered >= threshold * len(item):
                out[i, j] = (count, covered, len(item))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=18), st.lists(st.integers(0, 3), max_size=12))
def test_tiles_are_those_of_the_definition(doc, item):
    import numpy as np

    hits = [(a, b) for a in range(len(doc) - 1) for b in range(len(item) - 1) if doc[a : a + 2] == item[b : b + 2]]
    if not hits:
        assert brute_tiles(doc, item, 2)[0] == 0
        return
    places, spots = (np.array(x) for x in zip(*hits))
    found = op.tiles(places, spots, 2)
    assert (sum(n for _, _, n in found), len(found)) == brute_tiles(doc, item, 2)


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = [(n, words(rng, 24)) for n in range(6)]
    docs = []
    for n in range(60):
        text = words(rng, 60).split()
        item = rng.choice(items)[1].split()
        kind = n % 5
        if kind == 0:
            text[20:20] = item
        elif kind == 1:  # rearranged thirds
            text = text[:20] + item[16:] + text[20:30] + item[:8] + text[30:] + item[8:16]
        elif kind == 2:
            text[5:5] = item[:10]
        elif kind == 3:  # every fifth word changed
            text[9:9] = [w if i % 5 else "zz" for i, w in enumerate(item)]
        docs.append((n, " ".join(text).upper() if n % 2 else ", ".join(text)))
    expected = brute(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for part_words in (op.PART_WORDS, 30):
        got = {(r["doc_id"], r["item_id"]): (r["tiles"], r["covered"], r["words"]) for r in op.contaminated(d, b, part_words=part_words).collect()}
        assert got == expected
    assert {i for i, _ in expected} >= {n for n in range(60) if n % 5 in (0, 1)}
    assert {r[0] for r in op.clean(d, b).select("doc_id").collect()} == {n for n, _ in docs} - {i for i, _ in expected}


def test_odd_rows(spark, awkward, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "no id here at all"), (4, "no id here at all"), (5, awkward.where("doc_id = 7").first()["text"]), (5, "repeated item id of words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op.contaminated(awkward, items).collect()}
    assert got == {(6, 5), (7, 5)}
    out = op.clean(awkward, items)
    assert out.columns == awkward.columns and out.count() == awkward.count() - 3
    assert op.contaminated(no_docs, items).count() == 0 and op.contaminated(awkward, items.where("false")).count() == 0
    assert op.clean(awkward, items.where("false")).count() == awkward.count()


def test_repetitive_documents(spark):
    docs = spark.createDataFrame([(1, "la " * 20_000), (2, "la la la la lu")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "la la la la la la"), (2, "lu la la la la")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in op.contaminated(docs, items).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_planted_passages_are_found(spark):
    """All documents with a whole benchmark passage, found by plain containment, are reported."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    whole = {(r[0], r[1]) for r in d.crossJoin(b.withColumnRenamed("text", "t")).where(F.contains("text", "t")).select("doc_id", "item_id").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in op.contaminated(d, b).collect()}
    assert whole and whole <= got


def test_equal_hashes_of_unlike_words_are_no_match(spark, monkeypatch):
    real = op.K.grams

    def colliding(hashes, rows, k):
        g, at, first = real(hashes, rows, k)
        return g % op.np.uint64(3), at, first

    docs = [(1, "one two three four five six"), (2, "seven eight nine ten eleven twelve")]
    items = [(1, "one two three four five")]
    index = op._index(items, 4)
    monkeypatch.setattr(op.K, "grams", colliding)
    bad = op._index(items, 4)
    assert len(set(bad[0].tolist())) < 3 and len(index) == len(bad)

    class Shared:
        value = bad

    batch = op.pa.RecordBatch.from_arrays([op.pa.array([i for i, _ in docs]), op.pa.array([t for _, t in docs])], names=["doc_id", "text"])
    found = [tuple(r.values()) for b in op._matcher(Shared, 4, 0.5)([batch]) for r in b.to_pylist()]
    assert found == [(1, 1, 1, 5, 5)]
