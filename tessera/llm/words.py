"""Words and their 64-bit hashes for whole Arrow columns of text, by numpy, with no Python object for each word.

Nulls and odd rows: null and empty texts, and texts of blanks alone, have no words; a text longer than a chunk is worked
on by itself; an empty column gives no words and one place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at a time; a longer document makes a chunk of its own.
CHUNK_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(20_240_607).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 2**64))
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LOWER = np.frombuffer(LOWER, np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of each 64-bit value over the others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(1 << bits, _STEP)
    down = np.full(1 << bits, _STEP_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Prefix:
    """Polynomial hashes of any slice of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(max(16, int(len(values)).bit_length()))
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.total[ends] - self.total[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _STEP)


@dataclass
class Words:
    """The words of a chunk of texts: where each begins and ends in `data`, and which text it is of."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray  # of each text, the number of its first word; one more at the end

    def hashes(self) -> np.ndarray:
        return Prefix(_LETTER[self.data]).of(self.starts, self.ends)


def chunks(batches: Iterable[pa.RecordBatch], size: int = CHUNK_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about `size` bytes of text at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, until - at)
            at = until


def split(column: pa.Array, lower: bool = False) -> Words:
    """Words are runs of bytes that are not blank, tab, or one of the four line and page breaks; a null text has none."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), empty, empty, empty, np.zeros(len(column) + 1, np.int64))
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    starts_here = inside & ~before
    starts_here[edge] = inside[edge]
    ends_here = before & ~inside
    ends_here[edge] = before[edge]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    first = np.searchsorted(starts, offsets)
    return Words(_LOWER[data] if lower else data, starts, ends, np.repeat(np.arange(len(column)), np.diff(first)), first)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive word hashes."""
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k if len(out) else 0):
        out = out * _STEP + hashes[i : len(out) + i]
    return mix(out)
