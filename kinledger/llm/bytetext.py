"""Whole texts of an Arrow column as numpy arrays of bytes: words, lines, n-grams, hashes.

UTF-8 keeps ASCII apart from all other characters, so separators can be told byte by
byte. Hashes are 64-bit: a polynomial over the bytes of a span, taken from prefix sums,
then mixed. Nothing here depends on a batch's size or on the other rows of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Bytes of text that one block of rows holds, but for a longer single text.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits each depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

_byte = np.arange(256)
#: White space as in ``[\x20\x09-\x0D]`` separates words.
NOT_SPACE = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: Letters, digits and everything beyond ASCII, A-Z in lower case.
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
ALNUM = ((_byte >= 48) & (_byte <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_byte >= 128)
#: The first byte of each code point.
CODE_POINT = (_byte & 0xC0) != 0x80


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of block after block; null is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the longest runs of bytes marked ``inside``; no run leaves its row."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = inside[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of what ``\\n`` separates; an empty row has one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    rows = np.sort(rows, kind="stable")
    ends = np.empty_like(starts)
    ends[:-1] = np.where(rows[1:] == rows[:-1], starts[1:] - 1, offsets[1:][rows[:-1]])
    ends[-1:] = offsets[-1:]
    return starts, ends, rows


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point (its UTF-8 bytes, the first lowest; ASCII is itself), and the rows' offsets
    in code points. Bytes that are no UTF-8 count with what stands before them in their row."""
    opens = CODE_POINT[data]
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(opens)
    size = np.diff(np.append(start, len(data)))
    out = data[start].astype(np.uint64)
    for k in range(1, 4):
        more = size > k
        out[more] |= data[start[more] + k].astype(np.uint64) << np.uint64(8 * k)
    return out, np.searchsorted(start, offsets)


def fewest(rows: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
    """Indexes of at most ``most`` values of each row (sorted by row), those whose hash is least."""
    count = np.bincount(rows) if len(rows) else np.zeros(0, np.int64)
    if not len(count) or count.max() <= most:
        return np.arange(len(rows))
    order = np.lexsort((mix(values.astype(np.uint64)), rows))
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return np.sort(order[place < most])


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes, wherever they stand."""
    up, down = _grow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from offset to offset."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of each run of ``n`` words of a row."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(rows[n - 1 :] == rows[: len(rows) - n + 1])
    out = np.full(len(at), np.uint64(n), np.uint64)
    for i in range(n):
        out = out * _BASE + hashes[at + i]
    return at, mix(out)


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of ``n`` words; all words of a row with fewer make one."""
    at, out = windows(hashes, rows, n)
    count = np.bincount(rows) if len(rows) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if not len(short):
        return rows[at], out
    first = np.searchsorted(rows, short)
    h = count[short].astype(np.uint64)
    for i in range(n - 1):
        more = count[short] > i
        h[more] = h[more] * _BASE + hashes[first[more] + i]
    return np.concatenate([rows[at], short]), np.concatenate([out, mix(h)])


def counted(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) in order, and how often each stands."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    return rows[at], values[at], np.diff(np.append(at, len(rows)))


def packed(column: pa.Array) -> pa.Array:
    """Each text as a zstd frame, which shuffles in about half the bytes of Spark's own blocks."""
    press = zstandard.ZstdCompressor(level=3)
    return pa.array([None if x is None else press.compress(x) for x in column.cast(pa.binary()).to_pylist()], pa.binary())


def unpacked(column: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([None if x is None else press.decompress(x) for x in column.to_pylist()], pa.binary()).cast(pa.string())
