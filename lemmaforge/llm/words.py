"""Byte-level word kernel shared by the text operators.

Texts reach Python as Arrow string columns.  The kernel works on the UTF-8
buffer of a column directly, so tokenising costs a few NumPy passes per byte
instead of one Python object per word.  Every operator that needs words uses
one of two byte classes:

* ``BLANK``: words are maximal runs of bytes other than space and \\t..\\r;
* ``ALNUM``: words are maximal runs of ASCII letters, digits and any byte of a
  non-ASCII character.

Only ``A``-``Z`` are lower-cased.  Word hashes are 64 bits wide and do not
depend on the process, so they can be compared across tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Words beyond this many bytes are hashed by blake2b instead of the rolling sum.
LONG_WORD = 1 << 16
#: Bytes of text that one NumPy pass takes at a time.
CHUNK = 1 << 19
#: And rows.
CHUNK_ROWS = 4096

_b = np.arange(256)
BLANK = ~((_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D)))
ALNUM = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x41) & (_b <= 0x5A)) | ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80)
LOWER = np.where((_b >= 0x41) & (_b <= 0x5A), _b + 0x20, _b).astype(np.uint8)
#: For bytes.translate: A-Z lower-cased and every byte outside a word made a space.
ALNUM_TRANSLATE = bytes(int(LOWER[i]) if ALNUM[i] else 0x20 for i in range(256))

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SYMBOL = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))[LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            x = np.full(n, U(base), U)
            x[0] = U(1)
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def slices(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, offsets, bytes) of runs of rows of about ``limit`` bytes, CHUNK_ROWS rows at most.

    Nulls read as empty texts.  A row longer than ``limit`` comes alone.
    """
    column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, lo + CHUNK_ROWS, len(column))
        yield lo, hi, off[lo : hi + 1] - off[lo], data[off[lo] : off[hi]]
        lo = hi


def spans(off: np.ndarray, data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each row's first word (one more at the end)."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = kind[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = off[off < n]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if j == i + 1 and b - a > LONG_WORD:
            out[i] = 0
        else:
            up, down = _power(max(b - a, 1 << 16))
            total = np.empty(b - a + 1, U)
            total[0] = 0
            np.cumsum(_SYMBOL[data[a:b]] * up[: b - a], out=total[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        i = j
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        word = LOWER[data[starts[i] : ends[i]]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


def grams(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word sequences.

    A row of fewer words, but at least one, has its whole sequence as its only
    element; a row without words has none.
    """
    n = len(h)
    rolled = np.zeros(n, U)
    if n >= k:
        acc = np.zeros(n - k + 1, U)
        for i in range(k):
            acc = acc * _STEP + h[i : n - k + 1 + i]
        rolled[: n - k + 1] = mix(acc + U(k))
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(rolled[lo : hi - k + 1]))
        elif hi > lo:
            acc = np.zeros(1, U)
            for x in h[lo:hi]:
                acc = acc * _STEP + x
            out.append(mix(acc + U(hi - lo)))
        else:
            out.append(np.empty(0, U))
    return out
