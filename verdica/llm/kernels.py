"""Vectorised text kernels: Arrow string columns in, numpy arrays out.

All operators of this subpackage share one notion of a word and one family of
64-bit hashes, so that brute-force tests can restate them in a few lines:

* text is lower-cased by Arrow (``utf8_lower``) where an operator asks for it;
* a *word* is a maximal run of ASCII letters, digits and non-ASCII bytes (one of more than
  ``CHUNK_BYTES`` counts as several of that length, so that no single word needs unbounded room);
* the hash of a byte span is ``sum((byte + 1) * R**i) mod 2**64``, finished by
  the splitmix64 mixer;
* the hash of k consecutive words is a polynomial of their hashes, mixed again.

Null text reads as empty text.  Every function takes whole texts.  A batch is cut between rows;
a row beyond ``CHUNK_BYTES`` comes alone and is worked off in pieces, so temporaries are
bounded and only the hashes of a text's words (about as many bytes as its own) are held at once.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Hashes that are worked on at a time where a row has more.
BLOCK = 1 << 18

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_A = np.uint64(0xD6E8FEB86659FD93)

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
WORD[128:] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 2 * CHUNK_BYTES:
            _powers[name] = have
    return have


def release() -> None:
    """Gives memory back at the end of a task: idle Python workers live on beside the next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = np.asarray(x, np.uint64)
    if not x.ndim:
        return mix(x[None])[0]
    if len(x) > 4 * BLOCK:
        out = np.empty_like(x)
        for i in range(0, len(x), BLOCK):
            out[i : i + BLOCK] = mix(x[i : i + BLOCK])
        return out
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    at = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)
    return mix(at * _R) | np.uint64(1)


def lower(text: pa.Array) -> pa.Array:
    return pc.utf8_lower(text)


def view(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the int64 offsets of its rows."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, "")
    _, offsets, data = text.buffers()
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    if offsets is None or len(text) == 0:
        return np.empty(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    at = np.frombuffer(offsets, wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(text: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) for runs of whole rows of about ``limit`` bytes."""
    raw, at = view(text)
    start = 0
    while start < len(at) - 1:
        stop = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(at) - 1)
        yield start, raw[at[start] : at[stop]], at[start : stop + 1] - at[start]
        start = stop


def spans(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True within rows, and the offsets of rows among them."""
    n = len(member)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(at), np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    last = member.copy()
    last[:-1] &= ~member[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = member[inner]
    last[inner - 1] = member[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of one running polynomial."""
    if not len(starts):
        return np.empty(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_R, "up", len(raw))[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_R_INV, "down", len(raw) + 1)[starts])


def pieces(raw: np.ndarray, member: np.ndarray, limit: int | None = None):
    """(start, end) of stretches of a long row, cut at bytes that aren't members; a run of members longer than the limit is cut at it."""
    limit = limit or CHUNK_BYTES
    at = 0
    while at < len(raw):
        end = min(at + limit, len(raw))
        if end < len(raw) and member[raw[end - 1]] and member[raw[end]]:
            free = np.flatnonzero(~member[raw[at:end]])
            end = at + int(free[-1]) + 1 if len(free) else end
        yield at, end
        at = end


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets of rows among them."""
    if len(at) == 2 and len(raw) > CHUNK_BYTES:
        found = [words(raw[i:j], np.array([0, j - i]))[0] for i, j in pieces(raw, WORD)]
        hashes = np.concatenate(found)
        return hashes, np.array([0, len(hashes)])
    starts, ends, rows = spans(WORD[raw], at)
    return span_hashes(raw, starts, ends), rows


def grams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words within rows, the offsets of rows, and each one's first word."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64), np.zeros(len(rows), np.int64), np.empty(0, np.int64)
    total = hashes[: n - k + 1].copy()
    for j in range(1, k):
        total *= _A
        total += hashes[j : n - k + 1 + j]
    whole = np.ones(n - k + 1, bool)
    for j in range(1, k):  # those that cross into the next row
        cut = rows[1:-1] - j
        whole[cut[(cut >= 0) & (cut < len(whole))]] = False
    first = np.flatnonzero(whole)
    return mix(total[first] + np.uint64(k)), np.searchsorted(first, rows), first


def gram_blocks(hashes: np.ndarray, rows: np.ndarray, k: int):
    """What ``grams`` gives, in blocks where a single row has very many words; offsets and first words count from the row's start."""
    if len(rows) != 2 or len(hashes) <= 2 * BLOCK:
        yield grams(hashes, rows, k)
        return
    for i in range(0, len(hashes) - k + 1, BLOCK):
        g, at, first = grams(hashes[i : i + BLOCK + k - 1], np.array([0, len(hashes[i : i + BLOCK + k - 1])]), k)
        yield g, at, first + i


def row_ids(rows: np.ndarray) -> np.ndarray:
    """The row of each element, from the offsets of rows."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def occurrences(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many equal elements precede each within its row."""
    if not len(hashes):
        return np.empty(0, np.int64)
    if len(rows) == 2 and len(hashes) > 4 * BLOCK:  # one row: elements of unlike lowest bits can't be equal
        out = np.empty(len(hashes), np.uint32)
        low = (hashes & np.uint64(63)).astype(np.uint8)
        for part in range(64):
            mine = np.flatnonzero(low == part)
            out[mine] = _runs(hashes[mine])
        return out
    return _runs(hashes ^ mix(row_ids(rows).astype(np.uint64) + np.uint64(77)))


def _runs(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.arange(len(key))
    out = np.empty(len(key), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out
