"""Vectorised words, shingles and sets over batches of whole texts.

A chunk of documents is laid out as one byte array, and words, word hashes and
shingle hashes come out of numpy passes over it, so no Python code runs per word.
Hashes have 64 bits: a byte-table polynomial per word, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.uint64(0xD1B54A32D192ED03) * np.arange(16, dtype=np.uint64)
CHUNK_BYTES = 1 << 20
STRETCH = 4 << 20

_pow = {+1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _powers(n: int, sign: int = 1) -> np.ndarray:
    """The first n powers of the base or of its inverse, grown by doubling."""
    while len(_pow[sign]) < n:
        step = np.uint64(pow(int(_BASE), sign * len(_pow[sign]), 2**64))
        _pow[sign] = np.concatenate([_pow[sign], _pow[sign] * step])
    return _pow[sign]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Bytes that end a word: white space only, or all ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def hash_spans(raw: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """64-bit hashes of the non-empty byte spans at..to, in ascending order and without overlap.

    A long text is worked off in stretches, so what is held per byte stays small.
    """
    if not len(at):
        return np.empty(0, np.uint64)
    lens = to - at
    ends = np.cumsum(lens)
    if ends[-1] > STRETCH and len(at) > 1:
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(STRETCH, ends[-1], STRETCH)), len(at)])
        if len(cuts) > 2:
            return np.concatenate([hash_spans(raw[at[a] : to[b - 1]], at[a:b] - at[a], to[a:b] - at[a]) for a, b in zip(cuts[:-1], cuts[1:])])
    before = np.cumsum(lens) - lens
    small = np.int32 if len(raw) < 2**31 else np.int64
    place = np.arange(int(before[-1] + lens[-1]), dtype=small) - np.repeat(before.astype(small), lens)
    value = _BYTE[raw[np.repeat(at.astype(small), lens) + place]]
    value *= _powers(int(lens.max()))[place]
    return mix(np.add.reduceat(value, before) + lens.astype(np.uint64))


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one byte array, a space after each, and where each begins (and the end)."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), np.concatenate([[0], np.cumsum(sizes + 1)])


def word_places(texts: list[bytes], delimiters: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one lower-cased byte array, where each begins, each word's start and end in it, and the index of each text's first word."""
    raw, begins = laid_out(texts)
    raw = LOWER[raw]
    edge = np.diff(np.concatenate([[0], (~delimiters[raw]).view(np.int8), [0]]).astype(np.int8))
    at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return raw, begins, at, to, np.searchsorted(at, begins)


class Words:
    """The words of a chunk of documents.

    hash, start, end: of each word; start and end are byte places in its document.
    first: the index of each document's first word, with the total at the end.
    """

    def __init__(self, texts: list[bytes], delimiters: np.ndarray = SPACES):
        raw, begins, at, to, self.first = word_places(texts, delimiters)
        owner = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.start, self.end = at - begins[owner], to - begins[owner]
        self.hash = hash_spans(raw, at, to)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles and each document's first (total at the end).

        A document of fewer words gives one shingle, its whole sequence; one of none gives none.
        """
        n = np.diff(self.first)
        total = len(self.hash)
        h = np.zeros(max(total - k + 1, 0), np.uint64)
        for j in range(k):
            h += self.hash[j : j + len(h)] * _STEP[j]
        h = mix(h)
        count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        first = np.concatenate([[0], np.cumsum(count)])
        keep = np.zeros(total, bool)
        owner = np.repeat(np.arange(len(n)), n)
        inner = np.arange(total) - self.first[:-1][owner]
        keep[inner <= (n - k)[owner]] = True
        keep[(inner == 0) & (n < k)[owner]] = True
        out = np.zeros(total, np.uint64)
        out[: len(h)] = h
        for d in np.flatnonzero((n > 0) & (n < k)):
            a, b = self.first[d], self.first[d + 1]
            out[a] = mix(np.add.reduce(self.hash[a:b] * _STEP[: b - a], keepdims=True) ^ _SALT[b - a])[0]
        return out[keep], first


def runs_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs, for any k, and each document's first (total at the end)."""
    total = len(words.hash)
    n = np.diff(words.first)
    count = np.maximum(n - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    if not first[-1]:
        return np.empty(0, np.uint64), first
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * _powers(total)[:total], dtype=np.uint64)])
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(int(first[-1])) - first[owner] + words.first[owner]
    return mix((sums[at + k] - sums[at]) * _powers(total, -1)[at] ^ _SALT[k % 16]), first


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks and stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def pieces_of(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Every batch in slices of about so many bytes of text (a row is never split), with the texts of the slice; null counts as empty."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        begin = 0
        while begin < batch.num_rows:
            done = int(ends[begin - 1]) if begin else 0
            end = min(int(np.searchsorted(ends, done + size)) + 1, batch.num_rows)
            part = batch.slice(begin, end - begin)
            yield part, as_bytes(part.column(column))
            begin = end
        release()


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
