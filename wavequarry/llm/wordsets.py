"""5-word shingle sets of texts, computed over whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from wavequarry.llm.shared import mixed

rng = np.random.default_rng(20240229)
#: A random value for each byte; A-Z have those of a-z.
BYTES = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
EACH = BYTES.copy()  # A-Z apart
BYTES[65:91] = BYTES[97:123]
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20
powers_: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    if n > max(powers_, default=0):
        size = 1 << (n - 1).bit_length()
        powers_.clear()
        powers_[size] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, dtype=np.uint64)]) for x in (BASE, INVERSE))
    return next(iter(powers_.values()))


def words_at(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of texts that lie one behind the other in ``data``, beginning at ``starts``; the text it is in; its first and last byte."""
    white = WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    before = np.r_[True, white[:-1]] | edge[:-1]
    after = np.r_[white[1:], True] | edge[1:]
    first, last = np.flatnonzero(~white & before), np.flatnonzero(~white & after)
    up, down = powers(len(data))
    total = np.cumsum(values[data] * up[: len(data)])
    h = total[last] - np.where(first > 0, total[first - 1], np.uint64(0))
    return mixed(h * down[first]), np.searchsorted(starts, first, side="right") - 1, first, last


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z folded, and the text it is in."""
    return words_at(data, starts, BYTES)[:2]


def sets_of(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; of the whole text where it has fewer words; none without words."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        j = min(j, len(column))
        part = data[offsets[i] : offsets[j]]
        n = j - i
        if len(part):
            # empty texts share their start with the next one, which is the one that has the words
            h, text = word_hashes(part, offsets[i:j][np.r_[offsets[i + 1 : j] > offsets[i : j - 1], True]] - offsets[i])
            filled = np.flatnonzero(np.r_[offsets[i + 1 : j] > offsets[i : j - 1], True])
            text = filled[text]
        else:
            h, text = np.empty(0, np.uint64), np.empty(0, np.int64)
        bounds = np.searchsorted(text, np.arange(n + 1))
        grams = h[: max(0, len(h) - k + 1)].copy()
        for d in range(1, k):
            grams = mixed(grams) + h[d : d + len(grams)]
        grams = mixed(grams)
        for t in range(n):
            a, b = bounds[t], bounds[t + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                short = np.array([b - a], dtype=np.uint64)  # another start than that of whole shingles
                for x in h[a:b]:
                    short = mixed(short + x)
                yield short
            else:
                yield np.empty(0, np.uint64)
        i = j
