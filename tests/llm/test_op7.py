import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdica.llm import op7_one_permutation as op
from invented import words


def tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def jaccard(a, b):
    a, b = ({tuple(t[i : i + op.SHINGLE]) for i in range(len(t) - op.SHINGLE + 1)} for t in (tokens(a), tokens(b)))
    return len(a & b) / len(a | b)


def test_bins_against_a_loop():
    rng = np.random.default_rng(0)
    g, row = rng.integers(0, 2**64, 500, dtype=np.uint64), rng.integers(0, 5, 500)
    least = op.minima(g, row, 6, 16)
    for r in range(6):
        for b in range(16):
            mine = [x for x, y in zip(g.tolist(), row.tolist()) if y == r and x >> 60 == b]
            assert least[r, b] == (min(mine) if mine else 2**64 - 1)


def test_densified_bins_borrow_from_full_ones_alike():
    rng = np.random.default_rng(1)
    least = rng.integers(0, 2**63, (4, 64), dtype=np.uint64)
    least[0, 3:] = op._NONE
    least[1, ::2] = op._NONE
    least[2] = op._NONE
    out = op.densify(least)
    assert (out[2] == op._NONE).all() and (out[[0, 1, 3]] != op._NONE).all()
    full = least != op._NONE
    assert (out[full] == least[full]).all() and set(out[0]) <= set(least[0, :3])
    again = least.copy()
    again[3] = least[1]
    assert (op.densify(again)[3] == out[1]).all()


def test_packing_holds_the_low_bits():
    v = np.arange(16, dtype=np.uint64).reshape(2, 8)
    for bits in (1, 2, 4, 8):
        packed = op.pack(v, bits)
        assert packed.shape == (2, bits)
        unpacked = np.unpackbits(packed, axis=1).reshape(2, 8, bits) @ (1 << np.arange(bits)[::-1])
        assert (unpacked == (op.K.mix(v) & np.uint64((1 << bits) - 1))).all()


@pytest.mark.parametrize("bits", [1, 4])
def test_estimates_are_unbiased(spark, bits):
    rng = random.Random(2)
    pairs = []
    for n in range(240):
        a = words(rng, rng.choice([12, 60, 300])).split()
        cut = rng.randrange(len(a))
        pairs.append((" ".join(a), " ".join(a[:cut] + words(rng, len(a) - cut).split())))
    docs = spark.createDataFrame([(2 * n + i, t) for n, p in enumerate(pairs) for i, t in enumerate(p)], "doc_id long, text string")
    f = op.fingerprints(docs, bits=bits)
    x, y = f.where("doc_id % 2 = 0").alias("x"), f.where("doc_id % 2 = 1").alias("y")
    got = {r["n"]: r["s"] for r in x.join(y, F.expr("x.doc_id + 1 = y.doc_id")).select((F.col("x.doc_id") / 2).cast("int").alias("n"), op.similarity(F.col("x.fingerprint"), F.col("y.fingerprint"), bits=bits).alias("s")).collect()}
    errors = [got[n] - jaccard(*p) for n, p in enumerate(pairs)]
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < (0.12 if bits == 1 else 0.08)


def test_odd_rows(awkward, no_docs):
    rows = op.fingerprints(awkward).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["shingles"], r["empty_bins"]))
    assert by[1] == by[2] == by[3] == by[11] == [(None, 0, 256)]
    assert by[8] == by[9] and by[8][0][1:] == (1, 255) and len(by[8][0][0]) == 128
    assert by[4] == by[5] and by[6][0] == by[6][1]
    assert by[10][0][0] is not None
    assert op.fingerprints(no_docs).count() == 0
    with pytest.raises(ValueError):
        op.fingerprints(awkward, bins=100)


@pytest.mark.parametrize(("bins", "bits"), [(256, 4), (256, 1), (64, 8), (16, 2)])
def test_similarity_against_unpacked_bits(spark, bins, bits):
    rng = np.random.default_rng(4)
    rows = []
    for n in range(60):
        a = rng.integers(0, 2**bits, bins)
        b = np.where(rng.random(bins) < n / 60, a, rng.integers(0, 2**bits, bins))
        packed = [np.packbits(((v[:, None] >> np.arange(bits)[::-1]) & 1).astype(np.uint8)).tobytes() for v in (a, b)]
        chance = 2.0**-bits
        rows.append((n, *packed, float(max(0.0, ((a == b).mean() - chance) / (1 - chance)))))
    rows += [(100, None, rows[0][1], None), (101, None, None, None)]
    df = spark.createDataFrame(rows, "n int, a binary, b binary, want double")
    for r in df.withColumn("got", op.similarity(F.col("a"), F.col("b"), bins, bits)).collect():
        assert r["got"] == (None if r["want"] is None else pytest.approx(r["want"], abs=1e-12))


def test_copies_meet_their_leader(spark):
    rng = random.Random(6)
    base = [words(rng, 120) for _ in range(5)]
    docs = spark.createDataFrame([(i, base[i % 5]) for i in range(20)] + [(50, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["leader"], r["similarity"]) for r in op.to_leaders(op.fingerprints(docs)).collect()}
    assert {i: (i % 5, 1.0) for i in range(5, 20)}.items() <= got.items() and all(i >= 5 or s < 0.3 for i, (_, s) in got.items())
    assert op.to_leaders(op.fingerprints(docs.where("false"))).count() == 0
