"""Word shingles of whole Arrow batches as hashes, in numpy: no Python object for a word.

A word is a run of bytes other than space and 0x09 to 0x0D. A shingle is five consecutive
words; a text of one to four words has one shingle, of all its words; a text without words
(or null) has none. Shingles are 48-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
#: Bytes of text handled at once, so that working arrays stay in a core's cache; a longer text is handled alone.
SLICE_BYTES = 1 << 18
#: Bits of a shingle's hash. A slice numbers its texts in the other 16.
BITS = 48
_MASK = np.uint64((1 << BITS) - 1)

_rng = np.random.Generator(np.random.PCG64(20240229))
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
_FACTORS = _rng.integers(1 << 62, 1 << 63, SIZE, dtype=np.uint64) | np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2 ** 64, n of each at least."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES)
        _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts of some SLICE_BYTES; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        end = min(max(end, at + 1), len(texts), at + (1 << 16) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many words each text has. A word's hash is the polynomial of
    its bytes, taken from running sums over the whole slice, to which white space adds nothing."""
    counts = np.zeros(len(offsets) - 1, np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), counts
    word = ((data - np.uint8(9)) > 4) & (data != 0x20)
    first = word.copy()
    first[1:] &= ~word[:-1]
    opening = offsets[:-1][offsets[:-1] < len(data)]
    first[opening] = word[opening]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    up, down = _power_tables(len(data))
    sums = ((data + np.uint8(1)) * word).astype(np.uint64)  # no byte of UTF-8 is 255
    np.multiply(sums, up[: len(data)], out=sums)
    np.cumsum(sums, out=sums)
    until = np.append(sums[starts[1:] - 1], sums[-1])
    before = np.concatenate([[np.uint64(0)], until[:-1]])
    return mix((until - before) * down[starts]), np.diff(np.searchsorted(starts, offsets))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text << 48 | shingle) of every shingle, sorted, and the words of each text."""
    hashes, counts = words(data, offsets)
    if not len(hashes):
        return np.zeros(0, np.uint64), counts
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    n = max(len(hashes) - SIZE + 1, 0)
    full = np.zeros(n, np.uint64)
    for j in range(SIZE):
        full += hashes[j : j + n] * _FACTORS[j]
    whole = doc[:n] == doc[SIZE - 1 :] if n else np.zeros(0, bool)
    keys = [doc[:n][whole] << np.uint64(BITS) | mix(full[whole]) >> np.uint64(64 - BITS)]
    short = np.flatnonzero((counts > 0) & (counts < SIZE))
    if len(short):
        starts = np.concatenate([[0], np.cumsum(counts)])[short]
        parts = np.zeros(len(short), np.uint64)
        for j in range(SIZE - 1):
            has = counts[short] > j
            parts[has] += hashes[starts[has] + j] * _FACTORS[j]
        keys.append(short.astype(np.uint64) << np.uint64(BITS) | mix(parts + counts[short].astype(np.uint64)) >> np.uint64(64 - BITS))
    found = np.concatenate(keys)
    found.sort()
    return found, counts


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: text, shingle and how often the text has it."""
    if not len(keys):
        return keys, keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at] >> np.uint64(BITS), keys[at] & _MASK, np.diff(np.append(at, len(keys)))
