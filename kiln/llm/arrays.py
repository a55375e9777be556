"""Numpy kernels over the UTF-8 buffers of Arrow string columns.

A chunk is a run of rows with a bounded number of text bytes (one row may
exceed the bound: a text is never cut). Words are runs of characters other
than space and tab..carriage return, lines are split at ``\\n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1_500_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the n + 1 row bounds); a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and total + size > limit:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hasher(data: np.ndarray):
    """A function from (starts, ends) to 64-bit hashes of those byte spans,
    from one prefix sum of a polynomial modulo 2**64."""
    powers = np.empty(len(data) + 1, np.uint64)
    inverse = np.empty(len(data) + 1, np.uint64)
    powers[0] = inverse[0] = 1
    powers[1:] = _ODD
    inverse[1:] = _INVERSE
    np.cumprod(powers, out=powers)
    np.cumprod(inverse, out=inverse)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers[:-1], out=prefix[1:])

    def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    return spans


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of every word: a run of bytes that are not ``blank``."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~blank[data]
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = solid[1:-1][inner]
    inner = inner[inner > 0]
    last[inner - 1] = solid[1:-1][inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of every line; a row has one line more than newlines."""
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    at_end = np.ones(len(row), bool)
    at_end[:-1] = row[1:] != row[:-1]
    ends[at_end] = offsets[1:][row[at_end]]
    return starts, ends, row


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many (or, of numbers, the sum of) marked bytes each row has."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix count of code points: entry i counts those that start before byte i."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, found earlier in the array) for each key."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    ranked = keys[order]
    same[1:-1] = ranked[1:] == ranked[:-1]
    again, twice = np.empty(len(keys), bool), np.empty(len(keys), bool)
    again[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return twice, again


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables that end where a group of equal keys ends, from sorted batches."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        same = np.ones(len(held), bool)
        for k in keys:
            column = held[k].to_numpy()
            same &= column == column[-1]
        cut = len(same) - int(same.sum())
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None:
        yield held.combine_chunks()


def planes(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, so that equal high bytes stand together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


def pack(keys: np.ndarray, numbers: np.ndarray) -> bytes:
    """Sorted keys and a number for each, compressed: differences by byte planes."""
    steps = np.diff(keys.view(np.uint64), prepend=np.uint64(0))
    return pa.compress(planes(steps) + planes(numbers), "zstd", asbytes=True)


def unpack(blob: pa.Scalar, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob.as_buffer(), 16 * n, "zstd"), np.uint8)
    return np.cumsum(from_planes(raw[:8 * n], n), dtype=np.uint64).view(np.int64), from_planes(raw[8 * n:], n).view(np.int64)


def shingles(word: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words of a row, in text order, each
    with the number of the row's equal runs before it hashed in; a row of fewer
    words is one run."""
    total = len(word)
    roll = word.copy()
    for step in range(1, min(size, total)):
        inside = np.flatnonzero(row[:-step] == row[step:])
        roll[inside] = roll[inside] * _INVERSE + word[inside + step]
    first = np.ones(total, bool)
    first[1:] = row[1:] != row[:-1]
    keep = np.zeros(total, bool)
    if total >= size:
        keep[:total - size + 1] = row[:total - size + 1] == row[size - 1:]
    at = np.flatnonzero(keep | first)
    value, of = mix(roll[at]), row[at]
    key = value ^ mix(of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    place = np.arange(len(order))
    count = place - np.maximum.accumulate(np.where(fresh, place, 0))
    times = np.empty(len(order), np.uint64)
    times[order] = count
    return mix(value + times * _ODD), of
