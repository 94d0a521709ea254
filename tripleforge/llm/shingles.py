"""Word-shingle sets and similarity sketches of many texts at once, in NumPy.

Words are runs of bytes outside space and U+0009 to U+000D, with A-Z lower-cased. A word's 64-bit hash is a polynomial in
random byte values, a shingle's mixes the hashes of its words; a text's set is its distinct shingle hashes.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 19  # bytes handled at once, or one text
_C1, _C2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MULT = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


_TABLES: dict = {}


def _tables(n: int):
    """Byte values, white space, and powers of the multiplier and of its inverse modulo 2**64."""
    if _TABLES.get("n", 0) < n or n <= CHUNK + 4096 < _TABLES["n"]:  # a very long text's tables go with it
        size = max(n, CHUNK + 4096)
        value = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
        value[65:91] = value[97:123]
        white = np.zeros(256, bool)
        white[[32, *range(9, 14)]] = True
        up = np.full(size, np.uint64(_MULT))
        down = np.full(size, np.uint64(pow(_MULT, -1, 2**64)))
        up[0] = down[0] = 1
        _TABLES.update(n=size, value=value, white=white, up=np.cumprod(up), down=np.cumprod(down))
    return _TABLES["value"], _TABLES["white"], _TABLES["up"], _TABLES["down"]


def chunks(texts: list[bytes]):
    """Runs of texts of CHUNK bytes or of one text."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) + 1 <= CHUNK:
            size += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end


def word_places(texts: list[bytes], end: bytes = b" ") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, start, end) of every word, in order, with places in the texts joined by `end`; and those joined bytes."""
    data = np.frombuffer(end.join(texts) + end, dtype=np.uint8)
    value, white, up, down = _tables(len(data))
    edge = np.flatnonzero(np.diff(~white[data], prepend=False))
    start, stop = edge[::2], edge[1::2]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(value[data] * up[: len(data)], out=sums[1:])
    h = mix((sums[stop] - sums[start]) * down[start])
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    return np.searchsorted(begin, start, side="right") - 1, h, start, stop, data


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word, in order."""
    return word_places(texts)[:2]


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles of each text, all sets one after another, sorted within each). A text of fewer than width words has its whole sequence as one shingle, one without words has none."""
    doc, h = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n)))
    sh = h.copy()
    short = n < width
    for k in range(1, width):
        sh[: len(h) - k] = mix(sh[: len(h) - k] * _GOLD + h[k:]) if len(h) > k else sh[:0]
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        if short[i]:
            x = h[a]
            for k in range(a + 1, b):
                x = mix(np.array([x * _GOLD + h[k]]))[0]
            s = mix(np.array([x ^ np.uint64(b - a)]))
        else:
            s = np.unique(sh[a : b - width + 1])
        parts.append(s)
        sizes[i] = len(s)
    return sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def fast_sketches(sizes: np.ndarray, sets: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketches, one row of bins 16-bit values for each set.

    Round i hashes every element to a bin and a value in [i, i + 1); a bin keeps its least value. From round `bins` on, round
    i puts all elements into bin i - bins, so every bin is filled after 2 * bins rounds, most sets after a few. A set
    leaves when its bins are full. Two sketches agree in a bin with the sets' Jaccard similarity as probability, and their
    agreement is concentrated around it as for independent draws.
    """
    out = np.full((len(sizes), bins), np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    x = sets
    for i in range(2 * bins):
        r = mix(x + _GOLD * np.uint64(2 * i + 1))
        at = doc * bins + (((r >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64) if i < bins else doc * bins + (i - bins)
        np.minimum.at(out.reshape(-1), at, (np.uint64(i) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF)))
        full = (out != np.iinfo(np.uint64).max).all(axis=1)
        stay = ~full[doc]
        if not stay.any():
            break
        doc, x = doc[stay], x[stay]
    return (mix(out) >> np.uint64(48)).astype(np.uint16)


def set_digests(sizes: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set: sums of two mixes of its elements."""
    end = np.cumsum(sizes)
    out = []
    for salt in (1, 2):
        s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets + _GOLD * np.uint64(salt * 7919)))))
        out.append(mix(s[end] - s[end - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]
