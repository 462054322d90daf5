"""Whole-batch text hashing in numpy.

A batch of strings is one UTF-8 buffer, so word boundaries, word hashes and n-gram hashes
of every document in the batch come out of a few array operations instead of a loop over
words.  A word is a maximal run of ASCII letters, digits and non-ASCII characters of
lower-cased text (``[0-9a-z\\x80-\\U0010ffff]+``); everything else separates words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, np.bool_)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text handled at once; longer documents are still taken whole.
BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``p**i`` (or ``p**-i``) modulo 2**64 for i < n."""
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = pow(_P, -1, 1 << 64) if inverse else _P
        size = max(BLOCK * 2, 1 << (n - 1).bit_length() if n > 1 else 1)
        full = np.full(size, np.uint64(base), np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full, dtype=np.uint64)
        _powers[key] = have
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets start at 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def blocks(texts: pa.Array, limit: int = BLOCK):
    """Slices of at most ``limit`` bytes and 256 rows (a longer document is a slice of its own): (first row, slice)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, off = buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(n, i + 256, max(i + 1, j))
        yield i, texts.slice(i, j - i)
        i = j


def lowered(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, byte by byte, lengths unchanged."""
    low = _LOWER[raw]
    if len(low) > 1:
        at = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[at] += 32
    return low


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, words before each document) of every word; ``raw`` is a block's bytes."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    low = lowered(raw)
    inside = _WORD[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
    h = (total[end] - total[start]) * powers(n, True)[start]
    h = mix(h ^ (end - start).astype(np.uint64))
    return h, start, end, np.searchsorted(start, off)


def ngrams(h: np.ndarray, per: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word) of every run of n words inside one document.

    A document of fewer than n words, but at least one, gives the run of all its words.
    ``per`` counts the words before each document, as returned by :func:`words`.
    """
    m = len(h)
    count = np.diff(per)
    doc = np.repeat(np.arange(len(count)), count)
    if m == 0:
        return np.zeros(0, np.uint64), doc, np.zeros(0, np.int64)
    g = np.zeros(m, np.uint64)
    left = per[1:][doc] - np.arange(m)
    short = count < n
    for k in range(n):
        part = np.zeros(m, np.uint64)
        part[: m - k] = h[k:]
        if k and short.any():
            part[left <= k] = 0
        g = (g ^ part) * np.uint64(0x9FB21C651E98DF25)
        g ^= g >> np.uint64(29)
    keep = left >= n
    if short.any():
        at = per[:-1][short & (count > 0)]
        keep[at] = True
    pos = np.flatnonzero(keep)
    return mix(g[pos]), doc[pos], pos - per[:-1][doc[pos]]


def unique_per_doc(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, document) pairs of one block, ordered by document, then hash.

    The document takes the upper 8 bits of the sort key (a block has at most 256), so the
    hashes that come back have 56 bits.
    """
    key = np.sort((doc.astype(np.uint64) << np.uint64(56)) | (g >> np.uint64(8)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & np.uint64((1 << 56) - 1), (key >> np.uint64(56)).astype(np.int64)


def lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, document, number in its document) of every line that isn't blank.

    Lines are what lies between line feeds, byte for byte; a blank one holds only spaces, tabs
    and carriage returns.
    """
    n = len(raw)
    feed = np.flatnonzero(raw == 10)
    docs = len(off) - 1
    start = np.sort(np.concatenate((off[:-1], feed + 1)), kind="stable")
    owner = np.searchsorted(feed, off[:-1])  # feeds before each document
    doc = np.repeat(np.arange(docs), np.diff(np.append(owner, len(feed))) + 1)
    end = np.append(start[1:], n)
    last = np.append(doc[1:] != doc[:-1], True) if docs else np.zeros(0, np.bool_)
    end = np.where(last, off[1:][doc], end - 1)
    number = np.arange(len(doc)) - np.repeat(np.flatnonzero(np.append(True, last[:-1])), np.diff(np.append(np.flatnonzero(np.append(True, last[:-1])), len(doc)))) if docs else np.zeros(0, np.int64)
    solid = np.zeros(n + 1, np.int64)
    np.cumsum((raw != 32) & (raw != 9) & (raw != 13) & (raw != 10), out=solid[1:])
    full = solid[end] > solid[start]
    start, end, doc, number = start[full], end[full], doc[full], number[full]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
    h = (total[end] - total[start]) * powers(max(n, 1), True)[start] if len(start) else np.zeros(0, np.uint64)
    return mix(h ^ (end - start).astype(np.uint64)), start, end, doc, number
