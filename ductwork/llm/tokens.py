"""Words of whole Arrow string columns as numpy arrays: boundaries and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at once; a longer word is still hashed whole.
BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words up to white space; of words of letters, digits and bytes beyond ASCII.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive, in bytes) and row of each word."""
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, its A-Z lower-cased; equal words have equal hashes wherever they stand."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
        high = ends[j - 1]
        up, down = powers(int(high - low) + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((LOWER[data[low:high]].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def word_hash(word: str) -> np.uint64:
    """The hash that hashes() gives this word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return hashes(data, np.array([0]), np.array([len(data)]))[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most so many bytes of text, or one row."""
    if not batch.num_rows:
        return
    _, at = raw(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of n words; a row of fewer words, but not none, gives its whole sequence."""
    counts = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(counts)
    if len(words) >= n:
        h = np.zeros(len(words) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0xD1342543DE82EF95) + words[k : len(words) - n + 1 + k]
        whole = rows[: len(h)] == rows[n - 1 :]
        out, owner = mix(h[whole]), rows[: len(h)][whole]
    else:
        out, owner = np.zeros(0, np.uint64), np.zeros(0, rows.dtype)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([_fold(words[ends[r] - counts[r] : ends[r]]) for r in short], dtype=np.uint64)
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def _fold(words: np.ndarray) -> int:
    h = np.uint64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            h = h * np.uint64(0xD1342543DE82EF95) + w + np.uint64(1)
        return int(mix(np.array([h], dtype=np.uint64))[0])
