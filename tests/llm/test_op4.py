import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from verdica.llm import kernels as K
from verdica.llm import op4_order_minhash as op

from invented import words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.integers(0, 8))
def test_banded_distance(a, b, most):
    assert op.banded_distance(a, b, most) == min(distance(a, b), most + 1)


def edited(rng, text, share):
    out = []
    for w in text.split():
        r = rng.random()
        if r < share / 3:
            continue
        out.append("changed" + str(rng.randrange(99)) if r < 2 * share / 3 else w)
        if r > 1 - share / 3:
            out.append("added" + str(rng.randrange(99)))
    return " ".join(out)


def brute_pairs(docs):
    seqs = {i: tokens(t) for i, t in docs}
    out = set()
    ids = sorted(seqs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = seqs[i], seqs[j]
            most = op.allowed(len(a), len(b), op.SIMILARITY)
            if a and b and abs(len(a) - len(b)) <= most and op.banded_distance(a, b, most) <= most:
                out.add((i, j))
    return out


def groups(pairs, ids):
    head = {i: i for i in ids}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_recall_against_all_pairs(spark):
    rng = random.Random(8)
    docs = []
    for _ in range(60):
        base = words(rng, rng.choice([6, 9, 12, 15, 20, 25, 32, 60, 150]))
        docs.append(base)
        for share in (0.02, 0.06, 0.1, 0.15):
            docs.append(edited(rng, base, share))
    shared = words(rng, 60)  # a passage in many unlike documents
    docs += [words(rng, 120) + " " + shared + " " + words(rng, 120) for _ in range(30)]
    docs = list(enumerate(docs))
    got = {r["doc_id"]: r["keeper"] for r in op.duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    pairs = brute_pairs(docs)
    truth = groups(pairs, [i for i, _ in docs])
    mine = {i: got.get(i, i) for i, _ in docs}
    hit = sum(mine[a] == mine[b] for a, b in pairs)
    assert len(pairs) > 300 and hit >= 0.9 * len(pairs)
    assert all(truth[i] == truth[k] for i, k in got.items())  # nothing joined that isn't
    for length in (range(1, 16), range(16, 40), range(40, 999)):
        some = [(a, b) for a, b in pairs if len(tokens(docs[a][1])) in length]
        assert sum(mine[a] == mine[b] for a, b in some) >= 0.9 * len(some)


def test_groups_equal_those_of_all_pairs(spark):
    """Copies in clusters, a passage in many unlike documents: the groups are those of brute force."""
    rng = random.Random(12)
    docs, passage = [], words(rng, 50)
    for n in (2, 3, 5, 40):
        base = words(rng, 90)
        docs += [base, *(edited(rng, base, 0.03) for _ in range(n - 1))]
    docs += [words(rng, 20) + " " + passage + " " + words(rng, 20) for _ in range(60)]
    rng.shuffle(docs)
    docs = [(f"d{i:04d}", t) for i, t in enumerate(docs)]
    truth = groups(brute_pairs(docs), [i for i, _ in docs])
    table = spark.createDataFrame(docs, "doc_id string, text string")
    expected = {i: k for i, k in truth.items() if i != k}
    assert {r["doc_id"]: r["keeper"] for r in op.duplicates(table).collect()} == expected
    assert {r["doc_id"] for r in op.keep_one(table).collect()} == set(truth.values())


def test_blocks_of_a_bucket_compare_all(spark, monkeypatch):
    rng = random.Random(13)
    base = words(rng, 60)
    docs = list(enumerate([words(rng, 3) + " " + base + " " + words(rng, 60) for _ in range(25)] + [edited(rng, base, 0.15) for _ in range(25)]))
    table = spark.createDataFrame(docs, "doc_id int, text string")
    whole = sorted(map(tuple, op.duplicates(table).collect()))
    monkeypatch.setattr(op, "BLOCK_ROWS", 3)
    assert sorted(map(tuple, op.duplicates(table).collect())) == whole and whole


def test_repeated_ids_with_unlike_texts(spark):
    rng = random.Random(14)
    a, b = words(rng, 30), words(rng, 30)
    low, high = sorted([a, b])
    rows = [(1, low, "x"), (2, high, "z"), (2, low, "y"), (2, low, "w"), (3, high, "v"), (4, None, "u"), (4, None, "t"), (None, low, "s"), (None, low, "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(5)
    assert [tuple(r) for r in op.duplicates(table).collect()] == [(2, 1)]
    assert sorted(map(tuple, op.keep_one(table).collect()), key=repr) == sorted([(1, low, "x"), (3, high, "v"), (4, None, "t"), (None, low, "s"), (None, low, "s")], key=repr)
    alone = table.where("doc_id = 2")
    assert [tuple(r) for r in op.keep_one(alone).collect()] == [(2, low, "w")]


def test_a_long_row_is_sketched_as_in_one_piece(monkeypatch):
    rng = random.Random(15)
    text = pa.array([words(rng, 3000) + " " + "x" * 90 + " " + words(rng, 3000)])

    def made():
        (_, raw, at), = K.chunks(text)
        hashes, rows = K.words(raw, at)
        return op.sketch_rows(hashes, rows, 16, 4), op.whole_hash(hashes, rows, 11), op.bitmaps(hashes, rows)

    whole = made()
    monkeypatch.setattr(K, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(K, "BLOCK", 64)
    assert all((a == b).all() for a, b in zip(whole, made()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=20), st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=20))
def test_bitmaps_bound_the_distance(a, b):
    _, raw, at = next(K.chunks(pa.array([" ".join(a), " ".join(b)])))
    x, y = op.bitmaps(*K.words(raw, at)).view("uint64").tolist()
    lacking = max(sum((i & ~j).bit_count() for i, j in zip(x, y)), sum((j & ~i).bit_count() for i, j in zip(x, y)))
    assert lacking <= distance(a, b)


def test_order_matters(spark):
    rng = random.Random(4)
    parts = [words(rng, 40) for _ in range(4)]
    docs = [(1, " ".join(parts)), (2, " ".join(parts[::-1])), (3, " ".join(parts).replace(" ", "\n").upper())]
    got = [(r["doc_id"], r["keeper"]) for r in op.duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert got == [(3, 1)]


def test_odd_rows(awkward, no_docs):
    got = {(r["doc_id"], r["keeper"]) for r in op.duplicates(awkward).collect()}
    assert got == {(5, 4), (7, 6), (9, 8)}
    kept = op.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r[0] for r in kept.select("doc_id").collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 6, 8, 10, 11, 12, None]
    assert op.duplicates(no_docs).count() == 0 and op.keep_one(no_docs).count() == 0


def test_groups_grow_through_chains(spark):
    """A chain of copies, each an edit of the one before, is one group."""
    rng = random.Random(9)
    texts = [words(rng, 100)]
    for _ in range(6):
        texts.append(edited(rng, texts[-1], 0.08))
    docs = list(enumerate(texts))
    got = {r["doc_id"]: r["keeper"] for r in op.duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(1, 7), 0)
