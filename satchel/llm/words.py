"""Whole texts as byte arrays, their words and shingles as 64-bit numbers.

Helpers for tasks that read Arrow batches: a column of texts is one run of
UTF-8 bytes with offsets, and all work on it is done for the batch at once.
Words and shingles are told apart by 64-bit hashes (chance of any mistake in a
billion different words about 3 in 100).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

# The white space that ends a word.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLACK = np.ones(256, dtype=bool)
BLACK[list(SPACES)] = False
# Letters, digits and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more
    than there are texts). Nulls are empty texts."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a block hold at most ``limit`` bytes
    (BLOCK_BYTES if not given) or are one text."""
    limit = limit or BLOCK_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of a run of texts: ``starts`` and ``ends`` in bytes, 64-bit
    ``hashes`` of the words with A-Z lowered, and the text each belongs to
    (``doc``); ``first[d]`` is the number of the first word of text ``d``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = BLACK):
        keep = inside[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begins = keep.copy()
        begins[1:] &= ~keep[:-1] | edge[1:-1]
        stops = keep.copy()
        stops[:-1] &= ~keep[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, offsets)
        self._data, self._keep = data, keep

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.ends - self.starts
        at = np.cumsum(lengths) - lengths
        letters = _BYTE[_LOWER[self._data[self._keep]]]
        place = np.arange(len(letters)) - np.repeat(at, lengths)
        total = np.add.reduceat(letters * powers(int(lengths.max()))[place], at)
        return mix(total + lengths.astype(np.uint64))


    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of the first ``size`` bytes of each longer word."""
        long = self.ends - self.starts > size
        letters = _LOWER[self._data[self.starts[long][:, None] + np.arange(size)]]
        return self.doc[long], mix((_BYTE[letters] * powers(size)).sum(1, dtype=np.uint64) ^ np.uint64(size))


def runs(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words that lie in one text, and the
    number of the word where each begins."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for i, power in enumerate(powers(size + 1)[1:]):
        total += hashes[i : i + n] * power
    last = np.repeat(first[1:], np.diff(first))[:n]  # end of the text of each word
    begins = np.flatnonzero(np.arange(n) + size <= last)
    return mix(total[begins]), begins


def shingle_sets(words: Words, size: int = 5) -> list[np.ndarray]:
    """The set of ``size``-word shingles of each text, as sorted numbers. A
    text with fewer words has its whole sequence as one shingle, one without
    words none."""
    hashes = words.hashes
    shingles, begins = runs(hashes, words.first, size)
    cut = np.searchsorted(begins, words.first)
    counts, out = words.counts, []
    for d, n in enumerate(counts):
        if n >= size:
            out.append(np.unique(shingles[cut[d] : cut[d + 1]]))
        elif n:
            some = hashes[words.first[d] : words.first[d + 1]]
            out.append(mix((some * powers(size + 1)[1 : n + 1]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
