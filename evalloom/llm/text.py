"""Words, hashes and windows of whole Arrow string batches, as flat numpy arrays.

A batch is cut into pieces of a few MB of text, so the memory of a task follows
the piece (or the longest single document), not the batch.  Nulls count as empty
texts.  Equality of words, lines and windows is equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20

_rng = np.random.default_rng(20260101)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Kept(dict):
    """A table of this process alone: functions that use it travel to the tasks with an empty one."""

    def __reduce__(self):
        return _Kept, ()


_powers = _Kept()

#: byte classes
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PLAIN_WORD = ~SPACE
LICENCE_WORD = np.zeros(256, bool)
LICENCE_WORD[0x30:0x3A] = LICENCE_WORD[0x61:0x7B] = LICENCE_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows with about ``limit`` bytes of text, or one longer row."""
    column = batch.column(batch.schema.get_field_index(text))
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()).fill_null("" if not pa.types.is_large_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], (offsets[at : to + 1] - offsets[at])
        at = to


def running(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(STEP, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``[start, end)``; equal content gives equal hashes wherever it stands."""
    raw = (prefix[ends] - prefix[starts]) * powers(UNSTEP, len(prefix))[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


class Words:
    """The words of one piece: ``starts``, ``ends`` (byte places), ``bounds`` (first word of each row, then the total)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = PLAIN_WORD):
        inside = word_bytes[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        cuts = offsets[1:-1][offsets[1:-1] < len(data)]
        before[cuts] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.data, self.offsets = data, offsets
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self, prefix: np.ndarray | None = None) -> np.ndarray:
        return span_hash(running(self.data) if prefix is None else prefix, self.starts, self.ends)


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of ``k`` consecutive items within one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(bounds[1:], np.diff(bounds))  # the end of the row of each item
    starts = np.flatnonzero(np.arange(n) + k <= last[:n])
    joined = hashes[:n].copy()
    for j in range(1, k):
        joined *= STEP
        joined += hashes[j : n + j]
    return starts, mix(joined)[starts]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the spans between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    out, have = values, 1
    while have < w:
        add = min(have, w - have)
        out = np.minimum(out[: len(out) - add], out[add:])
        have += add
    return out


def ids_of(rows: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
