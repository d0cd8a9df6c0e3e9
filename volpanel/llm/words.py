"""Words of many texts at once: spans and 64-bit hashes from the UTF-8 bytes of an Arrow column.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased: digits, letters and every
character beyond ASCII. All of these are single byte classes in UTF-8, so no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 17
BLOCK_BYTES = 1 << 20


def byte_tables(seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Lower-casing of a byte, and its random weight (0: no part of a word)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    weight = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
    weight = weight[lower]
    weight[~word] = 0
    return lower, weight


LOWER, WEIGHT = byte_tables()
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other, and where each begins and the last ends. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` bytes of text, or one row."""
    _, offsets = text_bytes(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = max(begin + 1, min(end, batch.num_rows))
        yield batch.slice(begin, end - begin)
        begin = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; a word never goes on in the next text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = WEIGHT[data] != 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = word[begins]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = word[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each lower-cased word."""
    out = np.empty(len(starts), np.uint64)
    size = int((ends - starts).max(initial=0)) + CHUNK
    up, down = powers(BASE, size), powers(BASE_INVERSE, size)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        a, b = starts[i], ends[j - 1]
        value = WEIGHT[data[a:b]] * up[: b - a]
        at = starts[i:j] - a
        out[i:j] = np.add.reduceat(value, at) * down[at]
        i = j
    return mix(out)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts and ends, word hashes, and the first word of each text (with the total at the end)."""
    data, offsets = text_bytes(column)
    starts, ends = word_spans(data, offsets)
    return data, starts, ends, hash_words(data, starts, ends), np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then those of starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)
