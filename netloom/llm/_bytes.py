"""Vectorised kernels over the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call sees; a longer text is a call of its own.
CHUNK = 1 << 21
_rng = np.random.default_rng(0x5EED)
#: One random odd multiplier and its inverse modulo 2**64: hash(word) = sum value[byte_j] * R**j.
R = np.uint64(0x9E3779B97F4A7C15)
R_INV = np.uint64(pow(int(R), -1, 1 << 64))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same with A-Z read as a-z.
FOLDED_VALUE = BYTE_VALUE.copy()
FOLDED_VALUE[65:91] = BYTE_VALUE[97:123]
#: A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: What stays of 8 bytes read where a word has 0 to 8 left.
LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Letters: ASCII letters and every byte of a character beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """R**0 .. R**(n-1) modulo 2**64."""
    key, base = ("i", R_INV) if inverse else ("p", R)
    have = _powers.get(key)
    if have is None or len(have) < n:
        a = np.full((1 << max(16, (n - 2).bit_length())) + 1, base, np.uint64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if n <= 2 * CHUNK:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the whole word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def column(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_binary())
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def parts(buf: np.ndarray, offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of `inside` bytes; runs end with their row."""
    m = inside[buf]
    prev = np.empty_like(m)
    prev[:1] = False
    prev[1:] = m[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]
    prev[first] = False
    after = np.empty_like(m)
    after[-1:] = False
    after[:-1] = m[1:]
    after[offs[1:][offs[:-1] < offs[1:]] - 1] = False
    start = np.flatnonzero(m & ~prev)
    end = np.flatnonzero(m & ~after) + 1
    row = np.searchsorted(offs, start, "right") - 1
    return start, end, row


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray = FOLDED_VALUE) -> np.ndarray:
    """64-bit hashes of the spans' bytes."""
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value[buf] * powers(n), out=total[1:])
    return mix((total[end] - total[start]) * powers(n + 1, True)[start])


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z read as a-z. Each 8 bytes are mixed with their number before they are added up, so that no arrangement
    of letters cancels out, as it may in a polynomial of long words."""
    data = np.zeros(len(buf) + 8, np.uint8)
    data[: len(buf)] = FOLD[buf]
    eight = np.ndarray((len(buf) + 1,), "<u8", data, strides=(1,))
    n = end - start
    h = mix((eight[start] & LEFT[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    long = np.flatnonzero(n > 8)
    if len(long):
        more = (n[long] - 1) // 8
        first = np.cumsum(more) - more
        k = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at = np.repeat(start[long], more) + 8 * k
        piece = eight[at] & LEFT[np.minimum(np.repeat(end[long], more) - at, 8)]
        h[long] = mix(h[long] + np.add.reduceat(mix(piece ^ mix(k.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))), first))
    return h


def shingles(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every k-word shingle, with repeats, in text order. A row of fewer words has its whole sequence as one."""
    start, end, row = words(buf, offs, NOT_SPACE)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word_hashes(buf, start, end)
    c = np.uint64(0xD1342543DE82EF95)
    n = len(h)
    out_h, out_r = [], []
    if n >= k:
        same = row[k - 1 :] == row[: n - k + 1]
        acc = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            acc = acc * c + h[j : n - k + 1 + j]
        out_h.append(mix(acc[same]))
        out_r.append(row[: n - k + 1][same])
    count = np.bincount(row, minlength=len(offs) - 1)
    first = np.cumsum(count) - count
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            acc = np.full(len(short), m, np.uint64)
            for j in range(m):
                acc = acc * c + h[first[short] + j]
            out_h.append(mix(acc))
            out_r.append(short)
    hs, rs = np.concatenate(out_h), np.concatenate(out_r)
    order = np.argsort(rs, kind="stable")
    return hs[order], rs[order]


def distinct_per_row(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row: values and offsets by row. `row` is ascending."""
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    out = [np.unique(h[bounds[i] : bounds[i + 1]]) for i in range(n_rows)]
    offs = np.zeros(n_rows + 1, np.int64)
    np.cumsum([len(x) for x in out], out=offs[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), offs
