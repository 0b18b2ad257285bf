"""Token ids as flat binary files with 64-bit document offsets.

Each task writes one shard: ``shard-NNNNNN.bin``, the ids of its documents one after
another as unsigned integers (16 bits where the vocabulary and the end mark fit, else
32), and ``shard-NNNNNN.idx``, the 64-bit offsets at which its documents begin, and the
end.  Both are named only when complete, by an atomic rename, so a task that is run again
or twice leaves the same files.  Prefix sums over the shards' sizes give each shard its
base, the place of its first token and of its first document in the whole; they are
written as ``bases.json`` and make the offsets of the result global.  ``Corpus`` maps the
files into memory.

Tokens are those of a byte-level BPE.  A token never crosses from a non-space into a
space, nor from a letter into a mark, so a text is cut there, and each distinct piece is encoded once per worker and
looked up afterwards; the ids are those of encoding the whole text.

Defined cases: null and empty texts are documents of no tokens but the end mark; nothing
is dropped, not even repeated rows or null doc_ids, each is a document of its own; an
empty table gives no rows; special tokens' names in a text are ordinary text.
"""

from __future__ import annotations

import base64
import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, kind, require, shared_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
CACHE = 250_000  # pieces a Python worker remembers before it starts over
BATCH_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_SOLID = np.zeros(256, bool)  # bytes of no white space of any kind
_SOLID[33:127] = True
_SOLID[0xC3:0xE0] = True


class Encoder:
    """Ids of whole texts, by encoding each distinct piece once."""

    def __init__(self, path: str, end: int | None):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = end
        self.dtype = np.dtype("<u2") if max(max(ranks.values()), end or 0) < 1 << 16 else np.dtype("<u4")
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._bytes[list(ranks.values())] = [len(x) for x in ranks]
        self._forget()

    def _forget(self) -> None:
        self._known: dict[int, int] = {}
        self._pool = np.empty(1 << 20, self.dtype)
        self._starts, self._sizes = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self._used = 0

    def _learn(self, keys: np.ndarray, begin: np.ndarray, stop: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Numbers for new pieces.  Those that can't fuse with a neighbour are encoded as one text."""
        data = raw.tobytes()
        last, before = raw[stop - 1], raw[np.maximum(stop - 2, begin)]
        closed = _SOLID[last] | ((last >= 128) & (last < 192) & (before >= 0xC3) & (before < 0xE0))
        apart = (raw[begin] == 32) & closed & _SOLID[raw[np.minimum(begin + 1, stop - 1)]]
        order = np.concatenate([np.flatnonzero(apart), np.flatnonzero(~apart)])
        size, many = (stop - begin)[order], int(apart.sum())
        together = self._bpe.encode_ordinary(b"".join([data[begin[i] : stop[i]] for i in order[:many]]).decode())
        ends = np.searchsorted(np.cumsum(self._bytes[together]), np.cumsum(size[:many])) + 1 if many else np.empty(0, np.int64)
        alone = [self._bpe.encode_ordinary(data[begin[i] : stop[i]].decode()) for i in order[many:]]
        counts = np.concatenate([np.diff(ends, prepend=0), [len(x) for x in alone]]).astype(np.int64)
        ids = np.concatenate([np.asarray(together, self.dtype), *(np.asarray(x, self.dtype) for x in alone)])
        at, n = len(self._known), len(order)
        while at + n > len(self._starts):
            self._starts, self._sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self._starts, self._sizes))
        while self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.empty_like(self._pool)])
        self._pool[self._used : self._used + len(ids)] = ids
        self._starts[at : at + n] = self._used + np.cumsum(counts) - counts
        self._sizes[at : at + n] = counts
        self._used += len(ids)
        self._known.update(zip(keys[order].tolist(), range(at, at + n)))
        out = np.empty(n, np.int64)
        out[order] = np.arange(at, at + n)
        return out

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after another, and their number in each row; a very long row is encoded in stretches between cuts."""
        if len(at) == 2 and len(raw) > BATCH_BYTES and (parts := list(self._stretches(raw))) != [(0, len(raw))]:
            found = [self._encode(raw[i:j], np.array([0, j - i]))[0] for i, j in parts]
            ids = np.concatenate(found if self.end is None else [*found, np.array([self.end], self.dtype)])
            return ids, np.array([len(ids)])
        ids, count = self._encode(raw, at)
        if self.end is None:
            return ids, count
        return np.insert(ids, np.cumsum(count), self.end), count + 1

    def _stretches(self, raw: np.ndarray):
        at, size = 0, BATCH_BYTES
        while at < len(raw):
            end = min(at + size, len(raw))
            cuts = self._cuts(raw[at:end], np.array([0, end - at]))
            if end < len(raw):
                if len(cuts) < 2:  # none yet: look further
                    size *= 2
                    continue
                end = at + int(cuts[-1])
            yield at, end
            at, size = end, BATCH_BYTES

    def _encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self._cuts(raw, at)
        stop = np.append(begin[1:], len(raw))
        per_row = np.diff(np.searchsorted(begin, at))
        keys = K.span_hashes(raw, begin, stop) ^ K.mix((stop - begin).astype(np.uint64))
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self._known) > CACHE:
            self._forget()
        get = self._known.get
        where = np.array([get(key, -1) for key in distinct.tolist()], np.int64)
        new = np.flatnonzero(where < 0)
        if len(new):
            where[new] = self._learn(distinct[new], begin[first[new]], stop[first[new]], raw)
        where = where[back]
        sizes = self._sizes[where]
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        ids = self._pool[np.repeat(self._starts[where] - (ends - sizes), sizes) + np.arange(total)]
        row = np.repeat(np.arange(len(at) - 1), per_row)
        return ids, np.bincount(row, weights=sizes, minlength=len(at) - 1).astype(np.int64)

    @staticmethod
    def _cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Starts of pieces: rows, spaces and line ends after what surely isn't white, marks after ASCII letters."""
        if not len(raw):
            return np.empty(0, np.int64)
        white = (raw == 32) | (raw == 10)
        sure = (raw > 32) & (raw < 127)
        # the last byte of a two-byte letter from U+00C0 on
        sure[1:] |= (raw[1:] >= 128) & (raw[1:] < 192) & (raw[:-1] >= 0xC3) & (raw[:-1] < 0xE0)
        cut = np.zeros(len(raw), bool)
        cut[1:] = white[1:] & sure[:-1]
        cut[1:] |= _MARK[raw[1:]] & _LETTER[raw[:-1]]
        cut[at[:-1][np.diff(at) > 0]] = True
        return np.flatnonzero(cut)


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, end: int | None) -> Encoder:
    """One for each Python worker, which keeps its pieces from task to task."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def _write(files: pafs.FileSystem, path: str, parts) -> None:
    """Whole or not at all, whoever else writes the same."""
    draft = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as f:
        for x in parts:
            f.write(x)
    files.move(draft, path)


def _writer(out_dir: str, tokenizer: str, end: int | None):
    def run(batches):
        encoder, shard = _encoder(SparkFiles.get(tokenizer), end), TaskContext.get().partitionId()
        files, root = pafs.FileSystem.from_uri(out_dir)
        draft = f"{root}/shard-{shard:06d}.bin.{uuid.uuid4().hex}"
        offsets, place, total = [np.zeros(1, "<i8")], 0, 0
        stream = None
        for batch in batches:
            for start, raw, at in K.chunks(batch.column(1), BATCH_BYTES):
                if stream is None:
                    stream = files.open_output_stream(draft)
                ids, count = encoder.encode(raw, at)
                stream.write(ids.astype(encoder.dtype).tobytes())
                ends = total + np.cumsum(count)
                offsets.append(ends.astype("<i8"))
                n = len(count)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, n),
                        pa.array(np.full(n, shard, np.int32)),
                        pa.array(np.arange(place, place + n)),
                        pa.array(ends - count),
                        pa.array(count),
                    ],
                    names=["doc_id", "shard", "doc", "start", "tokens"],
                )
                place, total = place + n, int(ends[-1])
        if stream is not None:
            stream.close()
            files.move(draft, f"{root}/shard-{shard:06d}.bin")
            _write(files, f"{root}/shard-{shard:06d}.idx", (x.tobytes() for x in offsets))
        K.release()

    return run


def write(docs: DataFrame, out_dir: str | None = None, tokenizer: str = TOKENIZER, end: int | None = END) -> DataFrame:
    """Writes the files and returns the manifest: (doc_id, file, doc, start, tokens).

    ``doc`` and ``start`` count from the first document and token of the whole; the shard's file
    and its bases are in ``bases.json``.  ``tokenizer`` is a file that the driver has; it is sent to the
    executors.  Without ``out_dir`` the files go to a new folder under the shared one and stay there.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    out_dir = out_dir or f"{shared_dir(spark)}/verdica-tokens/{uuid.uuid4().hex}"
    spark.sparkContext.addFile(tokenizer)
    if "://" not in out_dir:
        out_dir = f"file://{out_dir}"
    files, root = pafs.FileSystem.from_uri(out_dir)
    files.create_dir(root, recursive=True)
    texts = require(docs, "doc_id", "text")
    made = scratch.table(texts.mapInArrow(_writer(out_dir, os.path.basename(tokenizer), end), f"doc_id {kind(docs, 'doc_id')}, shard int, doc bigint, start bigint, tokens bigint"), "manifest")
    sums = made.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).orderBy("shard").collect()  # a row for each shard
    bases, doc_base, token_base = [], 0, 0
    for r in sums:
        bases.append((r["shard"], doc_base, token_base))
        doc_base, token_base = doc_base + r["docs"], token_base + r["tokens"]
    width = _encoder(tokenizer, end).dtype
    text = json.dumps({"dtype": width.str, "docs": doc_base, "tokens": token_base, "shards": [{"name": f"shard-{s:06d}", "doc_base": d, "token_base": t} for s, d, t in bases]})
    _write(files, f"{root}/bases.json", [text.encode()])
    based = spark.createDataFrame(bases, "shard int, doc_base bigint, token_base bigint")
    return made.join(F.broadcast(based), "shard").select(
        "doc_id",
        F.format_string("shard-%06d.bin", "shard").alias("file"),
        (F.col("doc") + F.col("doc_base")).alias("doc"),
        (F.col("start") + F.col("token_base")).alias("start"),
        "tokens",
    )


class Corpus:
    """The written files, mapped into memory: ``corpus[n]`` has the ids of the n-th document."""

    def __init__(self, out_dir: str):
        self._dir = out_dir.removeprefix("file://")
        with open(f"{self._dir}/bases.json") as f:
            self.about = json.load(f)
        self._doc_bases = np.array([s["doc_base"] for s in self.about["shards"]], np.int64)
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return self.about["docs"]

    def _shard(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        if s not in self._open:
            name = f"{self._dir}/{self.about['shards'][s]['name']}"
            offsets = np.memmap(f"{name}.idx", "<i8", "r")
            ids = np.memmap(f"{name}.bin", self.about["dtype"], "r") if offsets[-1] else np.empty(0, self.about["dtype"])
            self._open[s] = (ids, offsets)
        return self._open[s]

    def __getitem__(self, n: int) -> np.ndarray:
        if not 0 <= n < len(self):
            raise IndexError(n)
        s = int(np.searchsorted(self._doc_bases, n, "right")) - 1
        ids, offsets = self._shard(s)
        n -= int(self._doc_bases[s])
        return ids[offsets[n] : offsets[n + 1]]
