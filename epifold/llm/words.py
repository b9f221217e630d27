"""Words, lines and hashes of whole texts, a block of Arrow rows at a time.

The functions run inside Spark tasks on the bytes of an Arrow string column.
No text is copied to Python objects: a word is a pair of byte positions and a
64-bit hash. Memory follows the block, not the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes hashed at once.
CHUNK = 1 << 17
#: Longest span hashed by a polynomial modulo 2^64. Its factors of two add up over
#: long patterned spans, so that those of a thousand bytes can clash; longer
#: spans take a digest.
SHORT = 64

# The white space that separates words.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1024)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are sorted and apart."""
    out = np.empty(len(starts), np.uint64)
    long = ends - starts > SHORT
    if long.any():
        held = memoryview(np.ascontiguousarray(data))
        digests = [hashlib.blake2b(held[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        out[long] = np.frombuffer(b"".join(digests), np.uint64)
        out[~long] = _short_spans(data, starts[~long], ends[~long])
        return out
    return _short_spans(data, starts, ends)


def _short_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        stop = int(ends[j - 1])
        up, down = powers(stop - base + 1)
        total = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(BYTE_CODE[data[base:stop]] * up[: stop - base], out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a column of strings or bytes; NULL is empty."""
    values = pc.fill_null(batch.column(name), "")
    width = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    buffers = values.buffers()
    if len(values) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], width)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most that many bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def text_blocks(batch: pa.RecordBatch, name: str, limit: int = BLOCK_BYTES):
    """(first row, row after the last, bytes, row offsets) of each block of a batch."""
    data, offsets = column(batch, name)
    for i, j in blocks(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes that stay in one text: starts, ends and the runs before each row."""
    n = len(inside)
    cut = np.ones(n + 1, bool)
    cut[1:n] = ~inside[: n - 1] if n > 1 else True
    cut[offsets] = True
    starts = np.flatnonzero(inside & cut[:n])
    cut[:n] = ~inside
    cut[n] = True
    cut[offsets] = True
    ends = np.flatnonzero(inside & cut[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: starts, ends and, per row, the number of words before it."""
    return spans_of(~IS_SEPARATOR[data], offsets)


def owners(counts: np.ndarray) -> np.ndarray:
    """The row of each item, given the number of items before every row."""
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def longs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of whole numbers as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64, copy=False)))
