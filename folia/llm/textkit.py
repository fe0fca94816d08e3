"""Vectorised text kernels shared by the operators of this subpackage.

A column of texts arrives as an Arrow array; `pieces` hands it out in slices of a few MB, each as one
byte array with row offsets, so that memory stays bounded however large a batch is. Words are found and
hashed for all rows of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Multiplier of the rolling hash; odd, so that it has an inverse modulo 2^64.
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words: digits, letters and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:256] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 21), base, U)
        out[0] = 1
        _powers[name] = have = np.cumprod(out, dtype=U)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the output."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def pieces(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets) of slices of about `limit` bytes; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, where, data = texts.buffers()
    offs = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def from_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of encoded texts."""
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offs


def runs(kind: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of equal non-zero `kind` that stays inside its row."""
    n = len(kind)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cut = np.zeros(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[offs] = True
    at = np.flatnonzero(cut)
    s, e = at[:-1], at[1:]
    keep = kind[s] != 0
    s, e = s[keep], e[keep]
    return s, e, np.searchsorted(offs, s, "right") - 1


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    n = len(buf)
    out = np.zeros(n + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * _power("p", _P, n), out=out[1:], dtype=U)
    return out


def span_hash(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [s, e); equal bytes give equal hashes wherever they stand."""
    inv = _power("i", _PINV, len(prefix))
    return mix((prefix[e] - prefix[s]) * inv[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))


#: A prime field beside arithmetic modulo 2^64, in which no strings are known that collide for every base.
_Q, _B = U(2**31 - 1), 1_234_567_891


def _prime_powers(name: str, base: int, n: int) -> np.ndarray:
    """Powers of a base in the prime field, by doubling."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 21), U)
        size, step = 1, U(base)
        while size < len(out):
            more = min(size, len(out) - size)
            out[size : size + more] = out[:more] * step % _Q
            size, step = size + more, step * step % _Q
        _powers[name] = have = out
    return have[:n]


def prime_prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums for `prime_hash`; of at most 2^32 bytes, so that sums stay below 2^63."""
    out = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * _prime_powers("q", _B, len(buf)) % _Q, out=out[1:], dtype=U)
    return out


def prime_hash(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """31-bit hashes of the byte spans [s, e), independent of `span_hash`."""
    inv = _prime_powers("r", pow(_B, -1, int(_Q)), len(prefix))
    return (prefix[e] - prefix[s]) % _Q * inv[s] % _Q


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and, with one more entry than rows, where each row's begin.

    Words are runs of digits, letters and bytes beyond ASCII, with A-Z in lower case. A row of fewer than
    k words, but not none, has one shingle of all of them.
    """
    low = LOWER[buf]
    s, e, row = runs(WORD[low].view(np.int8), offs)
    h = span_hash(prefix_hash(low), s, e)
    rows, m = len(offs) - 1, len(h)
    first = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(first)
    out = np.zeros(m, U)
    for j in range(k):
        part = np.zeros(m, U)
        part[: max(0, m - j)] = h[j:]
        out = (out + part) * U(0x9FB21C651E98DF25) + U(j + 1)
    whole = np.arange(m) + k <= first[row + 1] if m else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < k))
    for r in short:
        x = U(0)
        with np.errstate(over="ignore"):
            for y in h[first[r] : first[r + 1]]:
                x = (x + y) * U(0x9FB21C651E98DF25) + U(77)
        out[first[r]] = x
        whole[first[r]] = True
    begin = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(row[whole], minlength=rows) if m else np.zeros(rows, np.int64), out=begin[1:])
    return mix(out[whole]), begin
