"""Benchmark decontamination by greedy string tiling.

Documents and test items are sequences of lower-cased words.  Runs of ``min_match``
words, hashed as Karp-Rabin does, are the seeds; a document meets an item where they
share one; a seed counts where its words agree one by one, not just its hash.  For each such pair the matches are the maximal runs of seeds on a diagonal.
The longest is marked as a tile, what others overlap it is cut off, and so on while a
match of ``min_match`` words remains; equally long ones in the order of the document,
then of the item.  Tiles may lie in any order, so a passage whose sentences were
rearranged is covered as well.  The share of the item's words in tiles is its coverage;
a document with an item covered to ``threshold`` is contaminated.

The items travel to the tasks in parts of at most ``part_words`` words, one pass over the
documents for each, so that what a task holds is bounded however large the benchmark is.
Documents are not shuffled.

Defined cases: null text matches nothing; an item of fewer than ``min_match`` words (null
or empty ones too) can't be told from chance and contaminates nothing; repeated items and
repeated documents are reported once for each pair of ids; a document without a doc_id is
neither reported nor removed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, kind, require, sized

MIN_MATCH = 4
THRESHOLD = 0.5
PART_WORDS = 2_000_000


def tiles(places: np.ndarray, spots: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of the seed hits (place in the document, spot in the item): (place, spot, words)."""
    order = np.lexsort((places, places - spots))
    i, j = places[order], spots[order]
    cut = np.ones(len(i), bool)
    cut[1:] = (np.diff(i - j) != 0) | (np.diff(i) != 1)
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, len(i))) + min_match - 1
    heap = [(-n, a, b) for n, a, b in zip(size.tolist(), i[first].tolist(), j[first].tolist())]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    found = []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [a + x not in in_doc and b + x not in in_item for x in range(-n)]
        if all(free):
            found.append((a, b, -n))
            in_doc.update(range(a, a - n))
            in_item.update(range(b, b - n))
            continue
        start = None
        for x, ok in enumerate([*free, False]):
            if ok and start is None:
                start = x
            elif not ok and start is not None:
                if x - start >= min_match:
                    heapq.heappush(heap, (start - x, a + start, b + start))
                start = None
    return found


def _index(items: list[tuple], min_match: int):
    """Sorted seeds with the items and spots they stand for; lengths of items."""
    seeds, owners, spots, lengths, whole = [], [], [], [], []
    for n, (_, text) in enumerate(items):
        _, raw, at = next(K.chunks(K.lower(pa.array([text]))))
        hashes, rows = K.words(raw, at)
        lengths.append(len(hashes))
        whole.append(hashes)
        g, _, first = K.grams(hashes, rows, min_match)
        seeds.append(g), owners.append(np.full(len(g), n)), spots.append(first)
    if not seeds:
        return None
    seed, owner, spot = np.concatenate(seeds), np.concatenate(owners), np.concatenate(spots)
    order = np.argsort(seed, kind="stable")
    return seed[order], owner[order], spot[order], np.array(lengths), [x for x, _ in items], np.concatenate(whole)


def _hits(seed: np.ndarray, sieve: np.ndarray, g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the documents, number of the seed) of all equal hashes."""
    likely = np.flatnonzero(sieve[(g >> np.uint64(44)).astype(np.int64)])
    lo = np.searchsorted(seed, g[likely], "left")
    many = np.searchsorted(seed, g[likely], "right") - lo
    likely, lo, many = likely[many > 0], lo[many > 0], many[many > 0]
    each = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
    return np.repeat(first[likely], many), each


def _matcher(shared, min_match: int, threshold: float):
    def run(batches):
        seed, owner, spot, lengths, names, item_words = shared.value
        item_base = np.cumsum(lengths) - lengths
        # a table of 2**20 bits passes over almost all words of a document at once
        sieve = np.zeros(1 << 20, bool)
        sieve[(seed >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            text = K.lower(batch.column(1))
            for start, raw, at in K.chunks(text):
                hashes, rows = K.words(raw, at)
                hits = [_hits(seed, sieve, g, first) for g, _, first in K.gram_blocks(hashes, rows, min_match)]
                place, each = (np.concatenate(x) for x in zip(*hits)) if hits else (np.empty(0, np.int64),) * 2
                # equal fingerprints are checked word by word
                same = np.ones(len(place), bool)
                for x in range(min_match):
                    same &= hashes[place + x] == item_words[item_base[owner[each]] + spot[each] + x]
                place, each = place[same], each[same]
                if not len(place):
                    continue
                row = np.searchsorted(rows, place, "right") - 1
                item, where = owner[each], spot[each]
                order = np.lexsort((place, item, row))
                row, item, place, where = row[order], item[order], place[order], where[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(item) != 0)]))
                out = []
                for p, q in zip(new.tolist(), [*new[1:].tolist(), len(row)]):
                    n = lengths[item[p]]
                    spots = np.unique(where[p:q])
                    reach = min_match + np.minimum(np.diff(spots), min_match).sum()  # words of the item that seeds touch
                    if reach < threshold * n:
                        continue
                    found = tiles(place[p:q], where[p:q], min_match)
                    covered = sum(x for _, _, x in found)
                    if covered >= threshold * n:
                        out.append((int(row[p]) + start, names[item[p]], len(found), covered, int(n)))
                if out:
                    picked, ids, count, covered, size = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(picked)), pa.array(ids), pa.array(count, pa.int32()), pa.array(covered, pa.int32()), pa.array(size, pa.int32())],
                        names=["doc_id", "item_id", "tiles", "covered", "words"],
                    )

    return run


def _parts(benchmark: DataFrame, part_words: int):
    """The items in parts of bounded size, one in memory at a time."""
    part, words = [], 0
    for row in require(benchmark, "item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        part.append((row[0], row[1]))
        words += len(row[1]) // 4 + 1
        if words >= part_words:
            yield part
            part, words = [], 0
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, item_id, tiles, covered, words): documents and the items that they cover to the threshold."""
    spark = docs.sparkSession
    schema = f"doc_id {kind(docs, 'doc_id')}, item_id {kind(benchmark, 'item_id')}, tiles int, covered int, words int"
    texts = require(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    out = None
    for part in _parts(benchmark, part_words):
        index = _index(part, min_match)
        if index is None or not len(index[0]):
            continue
        found = texts.mapInArrow(_matcher(spark.sparkContext.broadcast(index), min_match, threshold), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "tiles", "words")).alias("m")).select(
        "doc_id", "item_id", F.col("m.tiles").alias("tiles"), F.col("m.covered").alias("covered"), F.col("m.words").alias("words")
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that cover no item to the threshold; the columns of ``docs``."""
    scratch = Scratch(docs.sparkSession, "tiling")
    gone = scratch.table(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "gone")
    return docs.join(sized(gone), "doc_id", "left_anti").select(docs.columns)
