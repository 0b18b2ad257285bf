import re

import numpy as np
import pyarrow as pa
import pytest

from verdica.llm import kernels as K
from verdica.llm import op6_importance as op

ROOT = "/root/testdata/sf0.1"


def brute_features(text):
    parts = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^\s0-9A-Za-z\u0080-\U0010ffff]+", text)
    return parts, ["same" if a == b else (a, b) for a, b in zip(parts, parts[1:])]


def test_features():
    texts = ["a a b, c!!", "", "x", "!! !! a", "tail end"]
    raw, at = K.view(pa.array(texts))
    bucket, row = op.features(raw, at)
    names = {}
    for i, t in enumerate(texts):
        parts, pairs = brute_features(t)
        mine = bucket[row == i]
        assert len(mine) == len(parts) + len(pairs)
        for b, f in zip(mine.tolist(), [*parts, *pairs]):
            assert names.setdefault(f, b) == b


def test_weights_and_draw_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = op.Model(d, labels)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    good = {r["doc_id"]: r["quality"] >= 1 for r in labels.collect()}
    raw, target = np.full(op.BUCKETS, 0.1), np.zeros(op.BUCKETS)
    counts = {}
    for i, t in texts.items():
        b, _ = op.features(*K.view(pa.array([t])))
        counts[i] = np.bincount(b, minlength=op.BUCKETS)
        raw += counts[i]
        if good.get(i):
            target += counts[i]
    raw /= raw.sum()
    ratio = np.log((target + op.PRIOR * op.BUCKETS * raw) / (target.sum() + op.PRIOR * op.BUCKETS)) - np.log(raw)
    rows = {r["doc_id"]: r for r in model.keys.collect()}
    for i, c in counts.items():
        assert rows[i]["weight"] == pytest.approx(float(c @ ratio), abs=1e-6)
    keys = sorted((r["key"] for r in rows.values()), reverse=True)
    assert model.k == sum(r["weight"] >= model.cut for r in rows.values())
    assert model.least == keys[model.k - 1]
    drawn = {r["doc_id"] for r in model.sample().collect()}
    assert drawn == {i for i, r in rows.items() if r["key"] >= keys[model.k - 1]} and len(drawn) == model.k
    assert {r["doc_id"] for r in model.keep(d).select("doc_id").collect()} == drawn


def test_held_out_accuracy(spark):
    """Fitted on half of the labels, judged on the other half."""
    d, labels = (spark.read.parquet(f"{ROOT}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in op.sample(d, labels.where("doc_id % 2 = 0")).collect()}
    ids = {r["doc_id"] for r in d.select("doc_id").collect()}
    held = [(r["doc_id"] in kept, r["quality"]) for r in labels.where("doc_id % 2 = 1").collect() if r["doc_id"] in ids]
    good, bad = [k for k, q in held if q], [k for k, q in held if not q]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.03


def test_cut():
    assert op.youden_cut(np.array([1.0, 2, 3, 4]), np.array([False, False, True, True])) == 2.5
    assert op.youden_cut(np.array([1.0, 2]), np.array([True, True])) is None
    assert op.youden_cut(np.array([1.0, 1.0]), np.array([True, False])) == 1.0


def test_kth_greatest(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-6, 6, 500), np.full(40, 3.5), [-1e300, 1e300]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    ordered = sorted(values.tolist(), reverse=True)
    for k in (1, 2, 250, 541, 542):
        assert op.kth_greatest(df, "x", k) == ordered[k - 1]
    assert op.kth_greatest(df.where("false"), "x", 1) is None


def test_odd_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame([(1, 1, "a"), (4, 1, "a"), (6, 1, "a"), (6, 1, "a"), (7, 0, "a"), (7, 1, "a"), (11, 0, "b"), (None, 1, "c"), (12, None, "c"), (999, 0, "c")], "doc_id long, quality int, good string")
    out = op.keep(awkward, labels)
    assert out.columns == awkward.columns
    ids = [r[0] for r in out.select("doc_id").collect()]
    assert ids.count(6) == 2 and 0 < len(ids) < awkward.count()
    assert op.sample(awkward, labels).count() == len(ids)
    one_kind = labels.where("quality = 1")
    assert op.keep(awkward, one_kind.where("doc_id <> 7")).count() == awkward.count()
    assert op.keep(awkward, labels.where("false")).count() == awkward.count()
    assert op.keep(no_docs, labels).count() == 0 and op.sample(no_docs, labels).count() == 0
    got = {r["doc_id"]: r["good"] for r in op.labelled(labels).collect()}
    assert got == {1: True, 4: True, 6: True, 7: False, 11: False, 999: False}
    assert op.labelled(labels, 2).count() == 2
