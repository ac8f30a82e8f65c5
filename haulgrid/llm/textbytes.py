"""Words of many texts at once, on their UTF-8 bytes, in numpy.

A batch of texts is one array of bytes with offsets. Words, their 64-bit hashes and windows over them come from a
few array operations for the whole batch, so that no Python code runs for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once; a longer text is a batch by itself.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)

#: What separates words where a contract says `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of successive parts; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, cut at the texts' borders; offsets of each text's words."""
    flags = np.zeros(len(is_word) + 2, bool)
    flags[1:-1] = is_word
    begins = flags[1:-1] & ~flags[:-2]
    inner = offsets[(offsets > 0) & (offsets < len(is_word))]
    begins[inner] |= is_word[inner]
    starts = np.flatnonzero(begins)
    stops = flags[1:-1] & ~flags[2:]
    stops[inner - 1] |= is_word[inner - 1]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    power = np.ones(int(lengths.max()), np.uint64)
    power[1:] = _BASE
    power = np.cumprod(power, dtype=np.uint64)
    code = _BYTE_CODE[data[place + np.repeat(starts, lengths)]] * power[place]
    return mix(np.add.reduceat(code, first) + lengths.astype(np.uint64))


def windows(hashes: np.ndarray, word_offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words that lie within one text, and the offsets of each text's windows."""
    n = len(hashes) - width + 1
    counts = np.maximum(np.diff(word_offsets) - width + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if n <= 0:
        return np.zeros(0, np.uint64), offsets
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * _STEP[k]
    starts = np.repeat(word_offsets[:-1], counts) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
    return mix(out[starts]), offsets


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The hash of one short sequence of words, apart from those of windows."""
    total = np.add.reduce(hashes * _STEP[32 : 32 + len(hashes)], dtype=np.uint64) + U64(len(hashes))
    return mix(np.array([total ^ U64(0x5851F42D4C957F2D)], np.uint64))[0]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)
