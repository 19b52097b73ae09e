"""Arrow text columns as numpy arrays: bounded slices, bytes, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RATIO = 0x9E3779B97F4A7C15 | 1
_RATIO_INVERSE = pow(_RATIO, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUE[SPACE] = 0
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _RATIO), ("down", _RATIO_INVERSE)):
            p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about `limit` text bytes, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end and each row's start; a null row is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where a word begins; rows never share a word."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    return np.flatnonzero(first)


def span_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from each start to the next one, white space left out."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        base = starts[done]
        stop = max(done + 1, int(np.searchsorted(starts, base + SLICE_BYTES, "right")) - 1)
        end = starts[stop] if stop < len(starts) else len(data)
        up, down = _powers(int(end - base))
        sums = np.add.reduceat(_BYTE_VALUE[data[base:end]] * up, starts[done:stop] - base)
        out[done:stop] = mix(sums * down[starts[done:stop] - base])
        done = stop
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the position of each row's first word (one more entry than rows)."""
    starts = word_starts(data, offsets)
    return span_hashes(data, starts), np.searchsorted(starts, offsets)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values per row; zero for an empty row."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=out.dtype)
    return out


def grams(hashes: np.ndarray, offsets: np.ndarray, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside each row, and each row's start among them.

    A row with 1 to n - 1 words gives its whole sequence when asked to.
    """
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - n + 1, 0)
    if whole_if_short:
        counts = np.where((sizes > 0) & (sizes < n), 1, counts)
    out_offsets = np.concatenate(([0], np.cumsum(counts)))
    rows = np.repeat(np.arange(len(sizes)), counts)
    at = offsets[:-1][rows] + np.arange(out_offsets[-1]) - out_offsets[:-1][rows]
    length = np.minimum(sizes, n)[rows]
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        live = k < length
        out[live] = mix(out[live] * np.uint64(0xD6E8FEB86659FD93) + hashes[at[live] + k] + np.uint64(k + 1))
    return out, out_offsets


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
