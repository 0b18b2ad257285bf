"""Near-duplicate removal by Order MinHash with banded alignment.

A document is its sequence of lower-cased words between two end marks.  Its ``MER``-word mers
are labelled by occurrence (the second "of the" differs from the first).  Under each of
``sketches`` hash functions the ``ELL`` least labelled mers are taken and kept in the order of
the text; two documents with an equal sketch are candidates.  The chance of an equal sketch
falls with edit distance, also by reordering alone.  Mer, ``ELL`` and the number of sketches
are the same for documents of any length.

Candidates are verified: the word-level edit distance, computed bit-parallel in a band
of half-width ``(1 - similarity) * longer`` around the diagonal, must not exceed that
half-width.  Verified pairs make groups (connected components); the least doc_id of a
group is kept.

Every document is a query; no bucket is capped.  Each document is first aligned with
the most frequent leader (least doc_id) of its buckets; then every candidate pair that
is still in two components is.  What is skipped is a pair that is in one group already, and
one that can't be similar: each word that only one side has takes an edit, and their number is
bounded from below by the bits that only one side has in bitmaps of ``SLOTS`` * 64 hashed words.
So the groups are those of aligning all candidate pairs, and texts meet only where bitmaps
agree.  The pairs of a bucket are compared in blocks of ``BLOCK_ROWS`` rows by all, so that a
passage that very many documents share is the work of many tasks.

Defined cases: doc_ids are of any type that can be ordered; null or wordless text is never a
duplicate and stays; equal word sequences are one group whatever their length; rows that
repeat a doc_id are one document, with the least of their texts, and the row with it stays (of
several, the least as JSON); rows without a doc_id stay; a document with fewer than ``ELL`` mers
has all of them as its sketch.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, components, kind, require, sized

SIMILARITY = 0.8
SKETCHES = 48
MER = 2
ELL = 3
#: 64-bit words of a document's bitmap.
SLOTS = 16
#: Rows of a bucket that one block of comparisons has on its left side.
BLOCK_ROWS = 4096
_BEGIN, _END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _labelled(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled mers of all rows, end marks included, and the offsets of rows."""
    count = len(rows) - 1
    place = np.arange(count)
    framed = np.empty(len(hashes) + 2 * count, np.uint64)
    framed[np.arange(len(hashes)) + 2 * K.row_ids(rows) + 1] = hashes
    framed[rows[:-1] + 2 * place], framed[rows[1:] + 2 * place + 1] = _BEGIN, _END
    rows = rows + 2 * np.arange(count + 1)
    mers = [g for g, _, _ in K.gram_blocks(framed, rows, MER)]
    mers = np.concatenate(mers) if len(mers) > 1 else mers[0]
    rows = rows - (MER - 1) * np.arange(count + 1)
    return K.mix(mers + K.occurrences(mers, rows).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), rows


class _Least:
    """The places of the ``ELL`` least values of each row under one hash function after another.

    Only values below a bound, which some 20 of a row are, take part in the search; where a row has
    too few of them, all of its values do.
    """

    def __init__(self, labelled: np.ndarray, rows: np.ndarray):
        self.labelled, self.rows, self.sizes = labelled, rows, np.diff(rows)
        self.long = len(self.sizes) == 1 and len(labelled) > 2 * K.BLOCK
        if not self.long:
            share = np.minimum(20.0 / np.maximum(self.sizes, 1), 1.0)
            bound = np.where(share < 1.0, share * 2.0**64, 0.0).astype(np.uint64)
            self.bound = np.repeat(np.where(share < 1.0, bound, _TOP), self.sizes)
            self.v, self.shifted, self.below = np.empty_like(labelled), np.empty_like(labelled), np.empty(len(labelled), bool)

    def places(self, a: np.uint64) -> np.ndarray:
        """ELL x rows, in the order of the text; ``len(labelled)`` where a row has fewer."""
        if self.long:
            return self._of_long(a)
        v = np.multiply(self.labelled, a, out=self.v)
        v ^= np.right_shift(v, np.uint64(32), out=self.shifted)
        some = np.flatnonzero(np.less_equal(v, self.bound, out=self.below))
        at = np.searchsorted(some, self.rows)
        few = np.flatnonzero(np.diff(at) < np.minimum(self.sizes, ELL))
        if len(few):
            some = np.union1d(some, np.concatenate([np.arange(self.rows[i], self.rows[i + 1]) for i in few]))
            at = np.searchsorted(some, self.rows)
        v, starts, sizes, found = v[some], at[:-1], np.diff(at), []
        for e in range(ELL):
            here = np.flatnonzero(v == np.repeat(np.minimum.reduceat(v, starts), sizes))
            if len(here) != len(sizes):  # equal hashes within a row, or a row with no more: take the earlier place
                here = here[np.searchsorted(here, starts)]
            found.append(np.where(sizes > e, some[here], len(self.labelled)))
            v[here] = _TOP
        return np.sort(np.stack(found), axis=0)

    def _of_long(self, a: np.uint64) -> np.ndarray:
        best: list[tuple[int, int]] = []
        for i in range(0, len(self.labelled), K.BLOCK):
            v = self.labelled[i : i + K.BLOCK] * a
            v ^= v >> np.uint64(32)
            bound = np.partition(v, min(ELL, len(v)) - 1)[min(ELL, len(v)) - 1]
            best = sorted(best + [(int(v[p]), int(p) + i) for p in np.flatnonzero(v <= bound)])[:ELL]
        return np.sort(np.array([[p] for _, p in best]), axis=0)


def sketch_rows(hashes: np.ndarray, rows: np.ndarray, count: int, seed: int) -> np.ndarray:
    """The sketches of rows that all have words, as a matrix."""
    labelled, at = _labelled(hashes, rows)
    out = np.empty((len(rows) - 1, count), np.uint64)
    if not len(out):
        return out
    least = _Least(labelled, at)
    for j, a in enumerate(K.seeds(count, seed)):
        key = np.full(len(out), np.uint64(j))
        for place in least.places(a):
            here = labelled[np.minimum(place, len(labelled) - 1)]
            key = K.mix(key * np.uint64(3) + np.where(place < len(labelled), here, np.uint64(7)))
        out[:, j] = key
    return out


def bitmaps(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows x SLOTS: the bits of all words of a row."""
    out = np.empty((len(rows) - 1, SLOTS), np.int64)
    for i in range(0, len(out), 4096):
        part = rows[i : min(i + 4096, len(out)) + 1]
        bits = np.zeros((len(part) - 1, SLOTS * 64), bool)
        if len(part) == 2:
            bits[0, (hashes[part[0] : part[1]] % np.uint64(SLOTS * 64)).astype(np.int64)] = True
        else:
            bits[K.row_ids(part - part[0]), (hashes[part[0] : part[-1]] % np.uint64(SLOTS * 64)).astype(np.int64)] = True
        out[i : i + len(bits)] = np.packbits(bits, axis=1).view(np.int64)
    return out


def whole_hash(hashes: np.ndarray, rows: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of each row's sequence of words."""
    n = np.diff(rows)
    total = np.zeros(len(n), np.uint64)
    for i in range(0, len(hashes), K.BLOCK) if len(n) == 1 else (0,) if len(n) else ():
        some = hashes[i : i + K.BLOCK] if len(n) == 1 else hashes
        place = np.arange(i, i + len(some)) - (0 if len(n) == 1 else np.repeat(rows[:-1], n))
        v = K.mix(some + K.mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(salt)))
        total += v.sum(dtype=np.uint64) if len(n) == 1 else np.add.reduceat(v, rows[:-1])
    return K.mix(total + n.astype(np.uint64))


_BITS = [f"b{i}" for i in range(SLOTS)]


def _sketcher(count: int, seed: int):
    def run(batches):
        for batch in batches:
            text = K.lower(batch.column(1))
            for start, raw, at in K.chunks(text):
                hashes, rows = K.words(raw, at)
                n = np.diff(rows)
                some = n > 0
                rows = rows[np.append(some, True)]
                n = n[some]
                whole = [whole_hash(hashes, rows, salt) for salt in (11, 12)]
                bits = bitmaps(hashes, rows)
                sketches = sketch_rows(hashes, rows, count, seed).view(np.int64)
                ends = np.arange(0, sketches.size + 1, count, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(some)).filter(pa.array(some)),
                        pa.array(n.astype(np.int32)),
                        pa.array(whole[0].view(np.int64)),
                        pa.array(whole[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(sketches.ravel())),
                        *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(SLOTS)],
                    ],
                    names=["doc_id", "n", "h1", "h2", "sketches", *_BITS],
                )
        K.release()

    return run


def banded_distance(a: list, b: list, most: int) -> int:
    """The edit distance of two sequences if at most ``most``, else ``most + 1``.

    The band starts narrow and widens as long as the distance exceeds it.
    """
    reach = 24
    while reach < most:
        if (found := _in_band(a, b, reach)) <= reach:
            return found
        reach *= 4
    return _in_band(a, b, most)


def _in_band(a: list, b: list, most: int) -> int:
    """As banded_distance, in one band.

    The vertical differences of a band of 2 * most + 1 cells slide down the diagonal as bits of
    one integer.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    low, shorter = 0, len(b)
    while low < shorter and a[low] == b[low]:
        low += 1
    end = 0
    while end < shorter - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    if not b:
        return len(a)
    if not most:
        return 1
    reach = min(most, len(a))
    width = 2 * reach + 1
    mask = (1 << width) - 1
    where: dict = {}
    for i, x in enumerate(a):  # bit i + reach, so that a right shift by j gives rows j - reach .. j + reach
        where[x] = where.get(x, 0) | (1 << (i + reach))
    rises, falls = mask >> reach << reach, 0
    score, corner, bottom, till = reach, 1 << (width - 1), 1 << (width - 2), len(a) - reach
    for j, x in enumerate(b):
        equal = (where.get(x, 0) >> j) & mask
        level = ((((equal & rises) + rises) ^ rises) | equal | falls) & mask
        right_up = falls | (mask & ~(level | rises))
        right_down = level & rises
        if j < till:  # follow the lowest diagonal of the band
            if not level & corner:
                score += 1
                if score > 2 * reach + len(b) - len(a) and score > most:
                    return most + 1
        else:  # follow the last row
            if right_up & bottom:
                score += 1
            if right_down & bottom:
                score -= 1
            bottom >>= 1
        rises = right_down | (mask & ~((level >> 1) | right_up))
        falls = (level >> 1) & right_up
    return min(score, most + 1)


def allowed(n: int, m: int, similarity: float) -> int:
    """The most word edits that leave two sequences of these lengths similar."""
    return math.floor((1 - similarity) * max(n, m) + 1e-9)


def apart(a: list, b: list, most: int) -> bool:
    """Surely more than ``most`` edits: each word that the other side lacks takes one."""
    x, y = set(a), set(b)
    return len(a) - sum(w in y for w in a) > most or len(b) - sum(w in x for w in b) > most


def _aligner(similarity: float):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(x[i].as_buffer(), np.uint64).tolist() for x in (left, right))
                most = allowed(len(a), len(b), similarity)
                if apart(a, b, most):
                    continue
                good[i] = banded_distance(a, b, most) <= most
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))
        K.release()

    return run


def _encoder(batches):
    for batch in batches:
        ids, text = batch.column(0), K.lower(batch.column(1))
        for start, raw, at in K.chunks(text):
            hashes, rows = K.words(raw, at)
            out = [hashes[rows[i] : rows[i + 1]].tobytes() for i in range(len(rows) - 1)]
            yield pa.RecordBatch.from_arrays([ids.slice(start, len(out)), pa.array(out, pa.binary())], names=["id", "words"])
    K.release()


def _lacking(x: str, y: str) -> Column:
    """How many bits x has that y lacks: no more than the words of x that y lacks."""
    return sum((F.bit_count(F.col(f"{x}.{b}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{b}")))) for b in _BITS), F.lit(0))


def _one_text(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text) of the documents, the least text where rows repeat a doc_id."""
    texts = require(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    again = scratch.table(texts.select("doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return texts
    once = texts.join(sized(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(sized(again), "doc_id", "left_anti").unionByName(scratch.table(once, "once"))


def duplicates(docs: DataFrame, similarity: float = SIMILARITY, sketches: int = SKETCHES, seed: int = 4) -> DataFrame:
    """(doc_id, keeper): every document that has a kept near copy, with the group's least doc_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "omh")
    id_type = kind(docs, "doc_id")
    texts = _one_text(docs, scratch)
    made = scratch.table(
        texts.mapInArrow(_sketcher(sketches, seed), f"doc_id {id_type}, n int, h1 bigint, h2 bigint, sketches array<bigint>, " + ", ".join(f"{b} bigint" for b in _BITS)), "sketches"
    )
    # equal word sequences, by 128 bits of hash
    same = made.select("doc_id", "h1", "h2").groupBy("h1", "h2")
    heads = scratch.table(same.agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")), "heads")
    copied = heads.where("copies > 1")
    exact = scratch.table(
        made.select("doc_id", "h1", "h2").join(copied.select("h1", "h2", "head"), ["h1", "h2"]).where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")),
        "exact",
    )
    per = made.join(sized(exact.select(F.col("a").alias("doc_id"))), "doc_id", "left_anti").select("doc_id", "n", F.explode("sketches").alias("key"))
    w = "partition by key"
    buckets = scratch.table(
        per.select("doc_id", "n", "key", F.expr(f"min(struct(doc_id, n)) over ({w})").alias("lead"), F.expr(f"max(doc_id) over ({w})").alias("last"))
        .where("lead.doc_id <> last")
        .select("key", "doc_id", "n", F.col("lead.doc_id").alias("lead"), F.col("lead.n").alias("lead_n")),
        "buckets",
    )

    def most(n: str, m: str) -> Column:
        return F.floor((1 - F.lit(similarity)) * F.greatest(n, m) + 1e-9)

    def near(n: str, m: str) -> Column:
        return F.abs(F.col(n) - F.col(m)) <= most(n, m)

    def may(n: str, m: str) -> Column:
        return F.greatest(_lacking("x", "y"), _lacking("y", "x")) <= most(n, m)

    def aligned(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.table(pairs, f"{name}-pairs")
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        ids = scratch.table(ids, f"{name}-ids")
        coded = scratch.table(texts.join(sized(ids), "doc_id", "left_semi").mapInArrow(_encoder, f"id {id_type}, words binary"), f"{name}-words")
        both = (
            pairs.join(coded.select(F.col("id").alias("a"), F.col("words").alias("left")), "a")
            .join(coded.select(F.col("id").alias("b"), F.col("words").alias("right")), "b")
            .select("a", "b", "left", "right")
        )
        out = scratch.table(both.mapInArrow(_aligner(similarity), f"a {id_type}, b {id_type}"), name)
        scratch.drop(f"{name}-pairs", f"{name}-ids", f"{name}-words")
        return out

    # first each document with the leader it meets most often
    counted = buckets.where("doc_id <> lead").where(near("n", "lead_n")).groupBy("doc_id", "lead").agg(F.count("*").alias("c"), F.struct(F.min("n").alias("n"), F.min("lead_n").alias("m")).alias("n"))
    best = counted.groupBy("doc_id").agg(F.max_by("lead", F.struct("c", F.col("lead").alias("l"))).alias("b"), F.max_by("n", F.struct("c", F.col("lead").alias("l"))).alias("n"))
    best = scratch.table(best.select(F.col("doc_id").alias("a"), "b", F.col("n.n").alias("n"), F.col("n.m").alias("m")), "best")
    met = scratch.table(best.select(F.col("a").alias("doc_id")).unionByName(best.select(F.col("b").alias("doc_id"))).distinct(), "met")
    bits = made.select("doc_id", *_BITS).join(sized(met), "doc_id", "left_semi")
    paired = best.join(bits.select(F.col("doc_id").alias("a"), F.struct(*_BITS).alias("x")), "a").join(bits.select(F.col("doc_id").alias("b"), F.struct(*_BITS).alias("y")), "b")
    stars = aligned(paired.where(may("n", "m")).select("a", "b"), "stars")
    first = components(stars, scratch, "first")
    # then all candidate pairs that are in two components yet
    placed = buckets.join(sized(first), buckets["doc_id"] == first["id"], "left").select("key", "doc_id", "n", F.coalesce("label", "doc_id").alias("label"))
    spread = placed.select("*", F.expr(f"min(label) over ({w})").alias("lo"), F.expr(f"max(label) over ({w})").alias("hi"), F.expr(f"count(*) over ({w})").alias("size")).where("lo <> hi")
    mixed = scratch.table(spread.select("key", "doc_id", "n", "label", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("blocks")), "mixed")
    ids = scratch.table(mixed.select("doc_id").distinct(), "mixed-ids")
    bits = made.select("doc_id", *_BITS).join(sized(ids), "doc_id", "left_semi")
    armed = scratch.table(mixed.join(bits, "doc_id"), "armed")
    x = armed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).alias("x")
    y = armed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.label") < F.col("y.label"))
    crossed = x.join(y, meet & near("x.n", "y.n") & may("x.n", "y.n")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    more = aligned(crossed, "crossed")
    groups = components(exact.unionByName(stars).unionByName(more), scratch, "groups")
    scratch.drop("again", "once", "sketches", "heads", "buckets", "best", "met", "mixed", "mixed-ids", "armed", "exact", "stars", "crossed", "first-edges", "groups-edges")
    return groups.where("id <> label").select(F.col("id").alias("doc_id"), F.col("label").alias("keeper"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without the near copies of a kept one; the columns of ``docs``."""
    gone = duplicates(docs, **options).select("doc_id")
    kept = docs.join(sized(gone), "doc_id", "left_anti").select(docs.columns)
    scratch = Scratch(docs.sparkSession, "omh-again")
    again = scratch.table(require(docs, "doc_id").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "ids")
    if again.isEmpty():
        return kept
    row = F.struct(*[docs[c] for c in docs.columns])
    several = docs.join(sized(again), "doc_id", "left_semi").select(docs["doc_id"].alias("id"), row.alias("row")).join(sized(gone.withColumnRenamed("doc_id", "id")), "id", "left_anti")
    once = several.groupBy("id").agg(F.min_by("row", F.struct(F.col("row.text").isNull(), F.col("row.text"), F.to_json("row"))).alias("row")).select("row.*")
    return kept.join(sized(again), "doc_id", "left_anti").select(docs.columns).unionByName(once)
