"""Vectorised work on the UTF-8 bytes of many texts at once (numpy over Arrow buffers)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the 64-bit mixing functions.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
M1, M2, M3, M4, M5 = map(U, MULTIPLIERS)

_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators of words: space and the controls 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KEYS = np.where(_SPACE, U(0), _BYTE_KEYS)
_LOWER_KEYS = _KEYS[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = (x ^ (x >> U(30))) * M2
    x = (x ^ (x >> U(27))) * M3
    return x ^ (x >> U(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column in a row, and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if not n or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return b, at - at[0]


def words(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of non-separators inside one text), and how many words each text has."""
    n = len(b)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    space = _SPACE[b]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_or(space[:-1], first[1:], out=before[1:])
    inside = ~space
    starts = np.flatnonzero(inside & before)
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_or(space[1:], first[1:], out=after[:-1])
    ends = np.flatnonzero(inside & after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


#: Bytes whose powers are held; further ones take them times a power of the whole.
_CHUNK = 1 << 14
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_CHUNK - 1, M5)]))
_INVERSES = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_CHUNK - 1, U(pow(int(M5), -1, 1 << 64)))]))


def word_hashes(b: np.ndarray, starts: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with lower, A-Z count as a-z.

    It mixes the sum of the bytes' keys times powers by place in the word. Powers are taken by place in b, which needs
    no place in the word, and each sum is brought back by the inverse power of where its word starts.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    b, at = b[starts[0] :], starts - starts[0]
    terms = (_LOWER_KEYS if lower else _KEYS).take(b, mode="clip")
    whole, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(p[-1:] * p[1], len(b) // _CHUNK)])) for p in (_POWERS, _INVERSES))
    for i, power in enumerate(whole):
        part = terms[i * _CHUNK : (i + 1) * _CHUNK]
        part *= _POWERS[: len(part)]
        part *= power
    return mix(np.add.reduceat(terms, at) * _INVERSES[at % _CHUNK] * back[at // _CHUNK])


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and how many each text has; a text with fewer words has its whole sequence as one."""
    n = len(hashes)
    have = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first, ends = np.cumsum(counts) - counts, np.cumsum(have)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    every = np.full(n, U(k), np.uint64)  # from each word on, over the ends of texts too
    for i in range(k):
        every = every * M1 + padded[i : i + n]
    out = every[np.arange(have.sum()) + np.repeat(first - (ends - have), have)] + np.array([k], np.uint64) * M4
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        size = counts[short]
        some = np.full(len(short), U(k), np.uint64)
        for i in range(k):
            some = some * M1 + np.where(i < size, padded[first[short] + i], U(0))
        out[ends[short] - 1] = some + size.astype(np.uint64) * M4
    return mix(out), have


def distinct_in_texts(values: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, sorted inside it, and how many each has."""
    out, sizes, at = [], np.zeros(len(have), np.int64), 0
    for i, n in enumerate(have.tolist()):
        if n:
            x = np.sort(values[at : at + n])
            x = x[np.concatenate([[True], x[1:] != x[:-1]])] if n > 1 else x
            out.append(x)
            sizes[i] = len(x)
            at += n
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), sizes


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as the first one and differences, in as few bytes as the largest difference takes."""
    if not len(values):
        return b""
    steps = np.diff(values).astype("<u8")
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + values[:1].astype("<u8").tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    width = data[0]
    if width in (1, 2, 4, 8):
        rest = np.frombuffer(data, f"<u{width}", offset=9)
    else:
        rest = np.zeros(((len(data) - 9) // width, 8), np.uint8)
        rest[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
        rest = rest.view("<u8")[:, 0]
    steps = np.empty(len(rest) + 1, np.uint64)
    steps[:1], steps[1:] = np.frombuffer(data, "<u8", 1, 1), rest
    return np.cumsum(steps, dtype=np.uint64)
