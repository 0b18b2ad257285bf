"""Licence scan by TF-IDF cosine to templates, with inheritance from directories.

A text is scored as a whole, line by line, and in all its windows of as many words as the
template has, so that a licence file, a header within a long file, and one amid other words of
a line or across lines are all found.  A unit's vector has ``(1 + ln tf) * idf`` for each
lower-cased word, hashed into ``DIMENSIONS``; the idf comes from the document frequencies of all
texts: ``ln((1 + texts) / (1 + df)) + 1``.  A licence's score is the greatest cosine of any unit
to any of its templates (of a window, where it reaches ``THRESHOLD``).  All windows are bounded by
running sums first; only those that may reach the threshold are scored in full, so that none is lost.

From ``THRESHOLD`` the text carries the licence of the best score.  Where templates of others come within
``MARGIN`` of it, the template of most words decides; of several as long the text carries what
their names have in common up to a dash (``GPL`` for a notice that fits several versions), or if
they have nothing the first in the alphabet.

A file whose name is that of a licence file lends its licence to its directory (of
several the best scored, then the first in the alphabet).  A file without a licence of its
own has that of the nearest directory above it that has one: the distinct directories
are joined to those with a licence by each of their ancestors, and the deepest match is
joined back to the files.  Text is never shuffled.

Defined cases: null and empty texts have no licence of their own and score 0; a null path
inherits nothing and lends nothing; a path without a slash lies in the root, ``""``, whose
licence holds for all; repeated rows are scanned each; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, require, sized
from .licenses import TEMPLATES

DIMENSIONS = 1 << 18
THRESHOLD = 0.6
MARGIN = 0.005
#: Words of the windows that are scored in full at a time.
WINDOW_WORDS = 1 << 20
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"


def _buckets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, offsets of rows among words, and where each word starts."""
    starts, ends, rows = K.spans(K.WORD[raw], at)
    return (K.span_hashes(raw, starts, ends) & np.uint64(DIMENSIONS - 1)).astype(np.int64), rows, starts


def _df_counter(batches):
    df, texts = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        texts += batch.num_rows
        for _, raw, at in K.chunks(K.lower(batch.column(0))):
            if len(at) == 2:  # a long one perhaps
                seen = np.zeros(DIMENSIONS, bool)
                for i, j in K.pieces(raw, K.WORD):
                    seen[_buckets(raw[i:j], np.array([0, j - i]))[0]] = True
                df += seen
                continue
            bucket, rows, _ = _buckets(raw, at)
            df += np.bincount(np.unique(K.row_ids(rows) * DIMENSIONS + bucket) % DIMENSIONS, minlength=DIMENSIONS)
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1).astype(np.int32)), pa.array(np.append(df[seen], texts))], names=["bucket", "df"])


def _vectors(unit: np.ndarray, bucket: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, bucket, weight) of the non-zero elements."""
    cells, tf = np.unique(unit * DIMENSIONS + bucket, return_counts=True)
    bucket = cells % DIMENSIONS
    return cells // DIMENSIONS, bucket, (1 + np.log(tf)) * idf[bucket]


class Templates:
    """The templates' unit vectors, and the licence of each."""

    def __init__(self, templates: dict, idf: np.ndarray):
        pairs = sorted((name, text) for name, texts in templates.items() for text in texts)
        self.licenses = sorted(templates)
        self.license = np.array([self.licenses.index(n) for n, _ in pairs])
        self.idf = idf
        self.row = np.full(DIMENSIONS, -1, np.int32)  # buckets that any template has
        raw, at = K.view(K.lower(pa.array([t for _, t in pairs], pa.string())))
        bucket, rows, _ = _buckets(raw, at)
        unit, bucket, weight = _vectors(K.row_ids(rows), bucket, idf)
        used = np.unique(bucket)
        self.row[used] = np.arange(len(used))
        self.matrix = np.zeros((len(used), len(pairs)))
        self.matrix[self.row[bucket], unit] = weight
        self.matrix /= np.maximum(np.sqrt((self.matrix**2).sum(axis=0)), 1e-300)
        self.words = np.diff(rows)

    def cosines(self, unit: np.ndarray, bucket: np.ndarray, count: int, only: int | None = None):
        """(template, cosine of each unit) for all templates, or one."""
        unit, bucket, weight = _vectors(unit, bucket, self.idf)
        norm = np.sqrt(np.bincount(unit, weights=weight**2, minlength=count))
        return self._products(unit, bucket, weight, norm, only)

    def _products(self, unit, bucket, weight, norm, only=None):
        row = self.row[bucket]
        hit = row >= 0
        unit, weight, row = unit[hit], weight[hit], row[hit]
        for t in range(self.matrix.shape[1]) if only is None else (only,):
            some = self.matrix[row, t] > 0
            dot = np.bincount(unit[some], weights=weight[some] * self.matrix[row[some], t], minlength=len(norm))
            yield t, np.minimum(np.divide(dot, norm, out=np.zeros(len(norm)), where=norm > 0), 1.0)

    def of_counts(self, tf: np.ndarray):
        """The same for one unit, given how often it has each bucket."""
        bucket = np.flatnonzero(tf)
        weight = (1 + np.log(tf[bucket])) * self.idf[bucket]
        return self._products(np.zeros(len(bucket), np.int64), bucket, weight, np.sqrt(np.array([(weight**2).sum()])))

    def windows(self, bucket: np.ndarray, row: np.ndarray, threshold: float):
        """(template, rows, cosines) of the windows within rows that reach the threshold.

        A word's weight grows by at most its idf with each repetition, which bounds the product
        from above; the square of ``1 + ln tf`` is at least tf times its ratio at the window's
        length (or 1), which bounds the norm from below.
        """
        at = self.row[bucket]
        hit = np.flatnonzero(at >= 0)
        hit_row, hit_idf = at[hit], self.idf[bucket[hit]]
        square = np.concatenate([[0.0], np.cumsum(self.idf[bucket] ** 2)])
        within = {n: row[: len(row) - n + 1] == row[n - 1 :] for n in np.unique(self.words).tolist() if 0 < n <= len(bucket)}
        least = {n: threshold * np.sqrt(np.maximum(square[n:] - square[:-n], 0) * min(1.0, (1 + np.log(n)) ** 2 / n)) - 1e-6 for n in within}
        part = np.zeros(len(bucket) + 1)
        for t, n in enumerate(self.words.tolist()):
            if n not in within:
                continue
            part[1:] = 0
            part[hit + 1] = self.matrix[hit_row, t] * hit_idf
            total = np.cumsum(part)
            first = np.flatnonzero((total[n:] - total[:-n] >= least[n]) & within[n])
            for i in range(0, len(first), max(1, WINDOW_WORDS // n)):
                some = first[i : i + max(1, WINDOW_WORDS // n)]
                words = (some[:, None] + np.arange(n)).ravel()
                for _, cos in self.cosines(np.repeat(np.arange(len(some)), n), bucket[words], len(some), t):
                    ok = cos >= threshold
                    yield t, row[some[ok]], cos[ok]


def _short(t: Templates, raw: np.ndarray, at: np.ndarray, threshold: float) -> np.ndarray:
    """Rows x templates: the scores of rows that are worked on together."""
    score = np.zeros((len(at) - 1, len(t.license)))
    bucket, rows, starts = _buckets(raw, at)
    if not len(bucket):
        return score
    row = K.row_ids(rows)
    for i, cos in t.cosines(row, bucket, len(score)):
        score[:, i] = cos
    # a word's line: line ends before it, and rows before it
    line = np.cumsum(raw == 10)[starts] + row
    _, line = np.unique(line, return_inverse=True)
    owner = np.zeros(line[-1] + 1, np.int64)
    owner[line] = row
    for i, cos in t.cosines(line, bucket, len(owner)):
        some = cos > 0
        np.maximum.at(score[:, i], owner[some], cos[some])
    for i, r, cos in t.windows(bucket, row, threshold):
        np.maximum.at(score[:, i], r, cos)
    return score


def _long(t: Templates, raw: np.ndarray, threshold: float) -> np.ndarray:
    """The same for one very long row, in pieces."""
    score = np.zeros((1, len(t.license)))
    parts, lines, ends = [], [], 0
    for i, j in K.pieces(raw, K.WORD):
        bucket, _, starts = _buckets(raw[i:j], np.array([0, j - i]))
        breaks = np.cumsum(raw[i:j] == 10, dtype=np.int32)
        parts.append(bucket.astype(np.uint32))
        lines.append(breaks[starts] + ends if len(starts) else np.empty(0, np.int32))
        ends += int(breaks[-1])
    bucket, line = np.concatenate(parts), np.concatenate(lines)
    parts, lines = [], []

    def put(found) -> None:
        for i, cos in found:
            score[0, i] = max(score[0, i], cos.max(initial=0.0))

    if not len(bucket):
        return score
    put(t.of_counts(np.bincount(bucket, minlength=DIMENSIONS)))
    at = 0
    while at < len(bucket):  # whole lines, about a block at a time
        end = min(at + K.BLOCK, len(bucket))
        if end < len(bucket):
            whole = int(np.searchsorted(line, line[end], "left"))
            end = whole if whole > at else int(np.searchsorted(line, line[end], "right"))
        if line[at] == line[end - 1]:
            put(t.of_counts(np.bincount(bucket[at:end], minlength=DIMENSIONS)))
        else:
            unit = (line[at:end] - line[at]).astype(np.int64)
            put(t.cosines(unit, bucket[at:end].astype(np.int64), int(unit[-1]) + 1))
        at = end
    reach = int(t.words.max())
    for at in range(0, len(bucket), K.BLOCK):
        part = bucket[at : at + K.BLOCK + reach - 1].astype(np.int64)
        put((i, cos) for i, _, cos in t.windows(part, np.zeros(len(part), np.int64), threshold))
    return score


def _named(t: Templates, score: np.ndarray, threshold: float) -> list[str | None]:
    best = score.max(axis=1, initial=0.0)
    out: list[str | None] = [None] * len(score)
    for r in np.flatnonzero(best >= threshold).tolist():
        close = np.flatnonzero(score[r] >= best[r] - MARGIN)
        names = sorted({t.licenses[i] for i in t.license[close[t.words[close] == t.words[close].max()]]})
        parts = [n.split("-") for n in names]
        same = next((n for n in range(min(map(len, parts)), 0, -1) if all(p[:n] == parts[0][:n] for p in parts)), len(parts[0]))
        out[r] = "-".join(parts[0][:same])
    return out


def scan_texts(text: pa.Array, t: Templates, threshold: float) -> tuple[list[str | None], np.ndarray]:
    """The licence and the best score of each text."""
    names, scores = [], []
    for _, raw, at in K.chunks(K.lower(text)):
        score = _long(t, raw, threshold) if len(at) == 2 and len(raw) > K.CHUNK_BYTES else _short(t, raw, at, threshold)
        names += _named(t, score, threshold)
        scores.append(score.max(axis=1, initial=0.0))
    return names, np.concatenate(scores) if scores else np.empty(0)


def _scanner(shared, threshold: float):
    def run(text: pa.Array) -> pa.Array:
        names, scores = scan_texts(text, shared.value, threshold)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=["license", "score"])

    return F.arrow_udf(run, "license string, score double")


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def ancestors(path: Column) -> Column:
    """A directory and all above it, the root "" last of all."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), up))


def idf_of(files: DataFrame) -> np.ndarray:
    counts = require(files, "text").select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_df_counter, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df, texts = np.zeros(DIMENSIONS), 0
    if len(counts):
        df[counts["bucket"][counts["bucket"] >= 0]] = counts["df"][counts["bucket"] >= 0]
        texts = int(counts["df"][counts["bucket"] < 0].sum())
    return np.log((1 + texts) / (1 + df)) + 1


def scan(files: DataFrame, templates: dict = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, license, score, basis, directory): basis is file, header, inherited or none."""
    spark = files.sparkSession
    scratch = Scratch(spark, "licenses")
    shared = spark.sparkContext.broadcast(Templates(templates, idf_of(files)))
    base = require(files, "doc_id", "path", "text").select("doc_id", "path", _scanner(shared, threshold)(F.coalesce("text", F.lit(""))).alias("x"))
    named = F.regexp_like(F.element_at(F.split("path", "/"), -1), F.lit(LICENSE_FILE))
    own = scratch.table(base.select("doc_id", "path", "x.license", "x.score", F.coalesce(named, F.lit(False)).alias("lends"), directory(F.col("path")).alias("dir")), "own")
    lent = own.where("lends and license is not null").groupBy("dir").agg(F.min_by("license", F.struct((-F.round("score", 9)).alias("s"), F.col("license").alias("l"))).alias("lent"))
    lent = scratch.table(lent, "lent")
    dirs = own.where("license is null and dir is not null").select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("up"))
    found = dirs.join(sized(lent.withColumnRenamed("dir", "up")), "up").groupBy("dir").agg(F.max_by(F.struct("up", "lent"), F.length("up")).alias("from"))
    found = scratch.table(found.select("dir", F.col("from.up").alias("up"), F.col("from.lent").alias("lent")), "found")
    joined = own.join(sized(found), "dir", "left")
    has = F.col("license").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("license", "lent").alias("license"),
        F.round("score", 9).alias("score"),
        F.when(has & F.col("lends"), "file").when(has, "header").when(F.col("lent").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(has, F.col("dir")).otherwise(F.col("up")).alias("directory"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents with paths: source/language/part/number.txt; short ones that speak of a licence are LICENSE files.

    Those lie at the top of their source, of its language or of its part by ``doc_id % 3``.
    """
    number = F.coalesce(docs["doc_id"].cast("string"), F.lit("none"))
    source, lang = F.coalesce(docs["source"], F.lit("none")), F.coalesce(docs["lang"], F.lit("none"))
    part = F.concat(F.lit("p"), F.coalesce(F.pmod(docs["doc_id"], F.lit(40)), F.lit(0)).cast("string"))
    is_license = F.coalesce((F.length(docs["text"]) < 600) & F.regexp_like(docs["text"], F.lit("(?i)licen[cs]ed? ")), F.lit(False))
    depth = F.coalesce(F.pmod(docs["doc_id"], F.lit(3)), F.lit(0))
    lic = F.when(depth == 0, F.concat_ws("/", source, F.lit("LICENSE"))).when(depth == 1, F.concat_ws("/", source, lang, F.lit("LICENSE"))).otherwise(F.concat_ws("/", source, lang, part, F.lit("LICENSE")))
    path = F.when(is_license, lic).otherwise(F.concat_ws("/", source, lang, part, F.concat(number, F.lit(".txt"))))
    return docs.select("doc_id", path.alias("path"), "text")
