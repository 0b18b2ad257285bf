"""Quality classifier by importance resampling of hashed n-grams.

Two generative models are counted: the *target* over the documents labelled good, the
*raw* over all documents.  Both are bags of word and word-pair features hashed into
``BUCKETS`` buckets; the target's counts are smoothed by ``PRIOR`` counts a bucket, spread
as the raw model spreads, so that a bucket seldom seen weighs nothing.  A word is a run of letters and digits of one
kind of case, punctuation runs are words of their own, and a word that repeats its
predecessor is a feature by itself.  A document's log importance weight is the sum of
``log p_target - log p_raw`` over its features.

Sampling without replacement by those weights is Gumbel top-k: a Gumbel variate drawn
from the hash of doc_id and seed is added (divided by ``sharpness``, the power to which
weights are raised) and the k greatest keys stay.  k is not guessed: the cut of the
weight that best separates the labelled good and bad (Youden's J; the lowest of equals)
is found on the labelled rows, and k is the number of all documents at or above it.  The
k-th key is found exactly, by counting in ranges that narrow around it.

Only the labels are bounded: of more than ``max_labels`` labelled ids, those with the
least hashes are used.  The models, weights, counts and selection cover all documents.

Defined cases: null or empty text has weight 0 and is sampled as such; keys that tie at
the k-th are all kept; a label whose quality is null, or that has no document, is
ignored; a stretch of over ``kernels.CHUNK_BYTES`` without white space counts as several of that
length; contradicting labels of one doc_id count as bad; with no good or no bad labels
there is nothing to separate and all documents stay; a null doc_id hashes like any value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, kind, require

BUCKETS = 1 << 13
PRIOR = 16
MAX_LABELS = 200_000
SHARPNESS = 10.0

_KIND = np.zeros(256, np.uint8)  # 0 space, 1 word, 2 other
_KIND[:] = 2
_KIND[K.WORD] = 1
_KIND[K.SPACE] = 0


_SOLID = ~K.SPACE


def _tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and punctuation runs in the order of the text, and the row of each."""
    shape = _KIND[raw]
    starts, ends, _ = K.spans(shape == 1, at)
    p_starts, p_ends, _ = K.spans(shape == 2, at)
    begin = np.concatenate([starts, p_starts])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.concatenate([ends, p_ends])[order]
    return K.span_hashes(raw, begin, end), K.row_ids(np.searchsorted(begin, at))


def _pairs(h: np.ndarray) -> np.ndarray:
    pair = K.mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])
    pair[h[:-1] == h[1:]] = np.uint64(12345)  # a repetition, whatever is repeated
    return pair


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, and the row of each."""
    h, row = _tokens(raw, at)
    if len(h) < 2:
        return _bucket(h), row
    same = row[:-1] == row[1:]
    return np.concatenate([_bucket(h), _bucket(_pairs(h)[same])]), np.concatenate([row, row[:-1][same]])


def feature_blocks(raw: np.ndarray, at: np.ndarray):
    """The same in blocks, where a row is very long: cut at white space, the pair across each cut included."""
    if len(at) != 2 or len(raw) <= K.CHUNK_BYTES:
        yield features(raw, at)
        return
    before = np.empty(0, np.uint64)
    for i, j in K.pieces(raw, _SOLID):
        h, _ = _tokens(raw[i:j], np.array([0, j - i]))
        found = np.concatenate([_bucket(h), _bucket(_pairs(np.concatenate([before, h])))])
        before = h[-1:] if len(h) else before
        yield found, np.zeros(len(found), np.int64)


def _counter(batches):
    """Per task: counts of each bucket over all its documents and over the good ones."""
    raw_counts, good_counts = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = np.asarray(batch.column(1).fill_null(False))
        for start, raw, at in K.chunks(batch.column(0)):
            mine = good[start : start + len(at) - 1]
            for bucket, row in feature_blocks(raw, at):
                raw_counts += np.bincount(bucket, minlength=BUCKETS)
                if mine.any():
                    good_counts += np.bincount(bucket[mine[row]], minlength=BUCKETS)
    seen = np.flatnonzero(raw_counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw_counts[seen]), pa.array(good_counts[seen])], names=["bucket", "raw", "good"])
    K.release()


def _scorer(ratios):
    def score(text: pa.Array) -> pa.Array:
        ratio, out = ratios.value, []
        for _, raw, at in K.chunks(text):
            out.append(sum(np.bincount(row, weights=ratio[bucket], minlength=len(at) - 1) for bucket, row in feature_blocks(raw, at)))
        return pa.array(np.concatenate(out) if out else np.empty(0))

    return F.arrow_udf(score, "double")


def labelled(labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, good): one row for each labelled id, at most ``max_labels`` of them."""
    one = require(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))
    return one.orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(max_labels)


def youden_cut(scores: np.ndarray, good: np.ndarray) -> float | None:
    """The lowest cut with the greatest (kept share of good) - (kept share of bad)."""
    if good.all() or not good.any():
        return None
    values, where = np.unique(scores, return_inverse=True)
    g = np.bincount(where, weights=good) / good.sum()
    b = np.bincount(where, weights=~good) / (~good).sum()
    kept = np.cumsum((g - b)[::-1])[::-1]
    best = int(np.flatnonzero(kept >= kept.max() - 1e-12)[0])
    if best == 0:
        return float(values[0])
    return float((values[best] + values[best - 1]) / 2)


def kth_greatest(keys: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th greatest double of a column, by counts in 4,096 ranges that narrow; only counts reach the driver."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return None
    while lo < hi:
        width = (hi - lo) / 4096
        if width == 0 or lo + width == lo:
            break
        place = F.least(F.floor((F.col(column) - lo) / width), F.lit(4095))
        rows = keys.where(F.col(column).between(lo, hi)).groupBy(place.alias("p")).agg(F.count("*").alias("c"), F.min(column).alias("a"), F.max(column).alias("b")).orderBy(F.desc("p")).collect()
        for r in rows:
            if k <= r["c"]:
                lo, hi = r["a"], r["b"]
                break
            k -= r["c"]
    return lo


class Model:
    """A fitted pair of models, the key of each document, and the key from which documents stay."""

    def __init__(self, docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, sharpness: float = SHARPNESS, seed: int = 6):
        spark = docs.sparkSession
        scratch = Scratch(spark, "importance")
        marks = scratch.table(labelled(labels, max_labels), "labels")  # bounded, so it may be broadcast
        texts = require(docs, "doc_id", "text").join(F.broadcast(marks), "doc_id", "left")
        counts = (
            texts.select(F.coalesce("text", F.lit("")).alias("text"), "good")
            .mapInArrow(_counter, "bucket int, raw bigint, good bigint")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
            .toPandas()
        )
        raw, good = np.full(BUCKETS, 0.1), np.zeros(BUCKETS)
        raw[counts["bucket"]] += counts["raw"]
        good[counts["bucket"]] += counts["good"]
        raw /= raw.sum()
        self.ratio = np.log((good + PRIOR * BUCKETS * raw) / (good.sum() + PRIOR * BUCKETS)) - np.log(raw)
        self._udf = _scorer(spark.sparkContext.broadcast(self.ratio))
        self._noise = f"-ln(-ln((shiftrightunsigned(xxhash64(doc_id, {int(seed)}), 11) + 0.5D) / 9007199254740992D)) / {float(sharpness)}D"
        self.keys = scratch.table(
            texts.select("doc_id", "good", self._udf(F.coalesce("text", F.lit(""))).alias("weight")).select("*", (F.col("weight") + F.expr(self._noise)).alias("key")), "keys"
        )
        known = self.keys.where("good is not null").select("weight", "good").toPandas()
        self.cut = youden_cut(known["weight"].to_numpy(), known["good"].to_numpy(bool)) if len(known) else None
        self.least = None
        if self.cut is not None:
            self.k = self.keys.where(F.col("weight") >= self.cut).count()
            self.least = kth_greatest(self.keys, "key", self.k) if self.k else float("inf")

    def sample(self) -> DataFrame:
        """(doc_id, weight, key) of the documents drawn."""
        keys = self.keys.select("doc_id", "weight", "key")
        return keys if self.least is None else keys.where(F.col("key") >= self.least)

    def keep(self, docs: DataFrame) -> DataFrame:
        """The documents drawn, with the columns of ``docs``; weights are computed anew, so that no text is shuffled."""
        if self.least is None:
            return docs
        weight = self._udf(F.coalesce(docs["text"], F.lit("")))
        return docs.where(weight + F.expr(self._noise) >= self.least)


def sample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return Model(docs, labels, **options).sample()


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return Model(docs, labels, **options).keep(docs)
