"""Document fingerprints by one-permutation MinHash.

The distinct shingles of a document (runs of ``SHINGLE`` lower-cased words) are hashed once;
the top bits of a hash choose one of ``BINS`` bins and each bin keeps the least of the other
bits.  An empty bin borrows from a bin chosen by a universal hash of (bin, attempt), the
attempts going on until a bin is met that was not empty from the start (optimal
densification), so two sets agree in a bin with the probability of their Jaccard
similarity.  Only the lowest ``BITS`` bits of each minimum are stored, packed.  Unequal
minima agree in them by chance one time in ``2**BITS``; the estimate of similarity
takes that off.

Defined cases: a document of fewer than ``SHINGLE`` words has its whole word sequence as
its one shingle; a document without words (null or empty text too) has no fingerprint
(null), and is similar to nothing (null); repeated rows give repeated fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, require

SHINGLE = 4
BINS = 256
BITS = 4
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles and the row of each; short rows have one."""
    g, at, _ = K.grams(hashes, rows, size)
    row = K.row_ids(at)
    n = np.diff(rows)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        total = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(hashes * np.uint64(3) + (np.arange(len(hashes)) - np.repeat(rows[:-1], n)).astype(np.uint64)), dtype=np.uint64)])
        g = np.concatenate([g, K.mix(total[rows[short + 1]] - total[rows[short]] + n[short].astype(np.uint64))])
        row = np.concatenate([row, short])
    return g, row


def minima(g: np.ndarray, row: np.ndarray, count: int, bins: int) -> np.ndarray:
    """The least hash of each row and bin, _NONE where there is none."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    cell = row.astype(np.int64) * bins + (g >> shift).astype(np.int64)
    out = np.full(count * bins, _NONE)
    order = np.lexsort((g, cell))
    cell = cell[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    out[cell[first]] = g[order][first]
    return out.reshape(count, bins)


def bin_minima(hashes: np.ndarray, rows: np.ndarray, size: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each row and bin, and the shingles of each row; a very long row block by block."""
    if len(rows) != 2 or len(hashes) <= 2 * K.BLOCK:
        g, row = shingles(hashes, rows, size)
        return minima(g, row, len(rows) - 1, bins), np.bincount(row, minlength=len(rows) - 1)
    least, count = np.full((1, bins), _NONE), 0
    for g, _, _ in K.gram_blocks(hashes, rows, size):
        least = np.minimum(least, minima(g, np.zeros(len(g), np.int64), 1, bins))
        count += len(g)
    return least, np.array([count])


def densify(least: np.ndarray) -> np.ndarray:
    """Fills the empty bins of rows that have any full one."""
    bins = least.shape[1]
    out, full = least.copy(), least != _NONE
    row, cell = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 1
    while len(row):
        # one number for (bin, attempt), the same for all documents
        source = (K.mix(cell.astype(np.uint64) * np.uint64(0x10001) + K.mix(np.uint64(attempt))) % np.uint64(bins)).astype(np.int64)
        good = full[row, source]
        out[row[good], cell[good]] = least[row[good], source[good]]
        row, cell, attempt = row[~good], cell[~good], attempt + 1
    return out


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each row's values, one after another in bytes."""
    low = (K.mix(values) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    planes = (low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(len(values), -1), axis=1)


def _printer(size: int, bins: int, bits: int):
    def run(text: pa.Array) -> pa.Array:
        prints, counts, empties = [], [], []
        for _, raw, at in K.chunks(K.lower(text)):
            least, count = bin_minima(*K.words(raw, at), size, bins)
            some = (least != _NONE).any(axis=1)
            packed = pack(densify(least), bits)
            prints += [packed[i].tobytes() if ok else None for i, ok in enumerate(some.tolist())]
            counts.append(count)
            empties.append((least == _NONE).sum(axis=1))
        flat = lambda x: np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32)
        return pa.StructArray.from_arrays([pa.array(prints, pa.binary()), pa.array(flat(counts)), pa.array(flat(empties))], names=["fingerprint", "shingles", "empty_bins"])

    return F.arrow_udf(run, "fingerprint binary, shingles int, empty_bins int")


def fingerprints(docs: DataFrame, size: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, shingles, empty_bins) for every row; no shuffle."""
    if bins & (bins - 1) or not 1 <= bits <= 8 or bins * bits % 8:
        raise ValueError("bins must be a power of two and bits 1 to 8, filling whole bytes")
    made = require(docs, "doc_id", "text").select("doc_id", _printer(size, bins, bits)(F.coalesce("text", F.lit(""))).alias("p"))
    return made.select("doc_id", "p.fingerprint", "p.shingles", "p.empty_bins")


def similarity(left: Column, right: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The estimated Jaccard similarity of two fingerprints, with the bias of chance agreement taken off.

    All in the JVM: the prints are compared 32 bits at a time; the bits in which a bin differs are
    folded onto its last one, and these are counted.  Null where a print is missing.
    """
    if 32 % bits:
        raise ValueError("bits must divide 32")
    lasts = F.lit(sum(1 << i for i in range(0, 32, bits)))
    total = bins * bits // 8

    def differing(at: int) -> Column:
        n = min(4, total - at)
        part = lambda c: F.conv(F.hex(F.substring(c, at + 1, n)), 16, 10).cast("bigint")
        x = part(left).bitwiseXOR(part(right))
        folded = x
        for i in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, i))
        return F.bit_count(folded.bitwiseAND(lasts))

    share = 1 - sum((differing(at) for at in range(0, total, 4)), F.lit(0)) / bins
    chance = 2.0**-bits
    return F.when(left.isNotNull() & right.isNotNull(), F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))


def to_leaders(prints: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, leader, similarity) of the documents that share the first 32 bits of their print with one of a lesser doc_id.

    Near copies agree in those bits with a probability that grows with their similarity.  Each is
    compared with the least doc_id of its group, so there are no more pairs than documents.
    """
    known = prints.where("fingerprint is not null").select("doc_id", "fingerprint", F.substring("fingerprint", 1, 4).alias("start"))
    some = Scratch(prints.sparkSession, "prints").table(known, "prints")
    leaders = some.groupBy("start").agg(F.min(F.struct("doc_id", "fingerprint")).alias("first"))
    pairs = some.join(leaders, "start").where(F.col("doc_id") > F.col("first.doc_id"))
    return pairs.select("doc_id", F.col("first.doc_id").alias("leader"), similarity(F.col("fingerprint"), F.col("first.fingerprint"), bins, bits).alias("similarity"))
