"""Words, hashes and n-grams of many texts at once, as numpy vectors over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at once; bounds the memory of prefix sums.
SPAN = 1 << 20
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes that separate words: white space of ASCII.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and their offsets (one more than texts). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if column.buffers()[2] is None else np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's offsets into them. inside: by byte, whether it belongs to words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    m = inside[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = m[0], m[-1]
    np.not_equal(m[1:], m[:-1], out=edge[1:n])
    cut = off[(off > 0) & (off < n)]
    cut = cut[m[cut] & m[cut - 1]]  # a word on both sides of the border between two texts
    starts = edge[:n] & m
    starts[cut] = True
    ends = edge.copy()
    ends[:n] &= ~m
    ends[n] = m[-1]
    ends[cut] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    return s, e, np.searchsorted(s, off)


def _pows(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(n, base, U)
        x[0] = 1
        _powers[base] = np.cumprod(x)
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s[i]:e[i]]; s ascends. A polynomial over the bytes, from prefix sums, then mixed."""
    out, i = np.empty(len(s), U), 0
    while i < len(s):
        a = s[i]
        j = max(i + 1, int(np.searchsorted(s, a + SPAN)))
        b = int(e[i:j].max())
        part = data[a:b].astype(U)
        part += U(1)
        part *= _pows(_MUL, len(part))[: len(part)]
        c = np.empty(len(part) + 1, U)
        c[0] = 0
        np.cumsum(part, out=c[1:])
        out[i:j] = (c[e[i:j] - a] - c[s[i:j] - a]) * _pows(_INV, len(part) + 1)[s[i:j] - a]
        i = j
    out ^= (e - s).astype(U) * U(0xD6E8FEB86659FD93)
    return mix(out)


def spaced(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with exactly one space after each; their new starts and ends."""
    n = e - s
    ns = np.zeros(len(s), np.int64)
    np.cumsum(n[:-1] + 1, out=ns[1:])
    ne = ns + n
    out = np.full(int(ne[-1]) + 1 if len(s) else 0, 0x20, np.uint8)
    if len(s):
        keep = np.zeros(len(data) + 1, np.int8)
        keep[s] += 1
        keep[e] -= 1  # 0 where a word stands right behind another, of the next text
        inside = np.cumsum(keep[:-1], dtype=np.int8).view(bool)
        at = np.ones(len(out), bool)
        at[ne] = False
        out[at] = data[inside]
    return out, ns, ne


_P1, _P2, _P3, _P4, _P5 = map(U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[s[i]:e[i]] for all i, as the published algorithm has it."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    w8 = np.ndarray((len(pad) - 7,), np.uint64, pad, 0, (1,))
    w4 = np.ndarray((len(pad) - 7,), np.uint32, pad, 0, (1,))
    out = np.empty(len(s), U)
    for i in range(0, len(s), 1 << 18):
        out[i : i + (1 << 18)] = _xxh64(pad, w8, w4, s[i : i + (1 << 18)], e[i : i + (1 << 18)], seed)
    return out


def _xxh64(pad, w8, w4, s, e, seed):
    n, p = e - s, s.copy()
    h = np.full(len(s), (seed + int(_P5)) & (2**64 - 1), U)
    long = np.flatnonzero(n >= 32)
    if len(long):
        m = U(2**64 - 1)
        v = [np.full(len(long), int(U(seed) + x & m) if x is not None else 0, U) for x in (U((int(_P1) + int(_P2)) & (2**64 - 1)), _P2, U(0))]
        v.append(np.full(len(long), (seed - int(_P1)) & (2**64 - 1), U))
        left, k = n[long] // 32, 0
        live = np.arange(len(long))
        while len(live):
            q = p[long[live]]
            for j in range(4):
                v[j][live] = _round(v[j][live], w8[q + 8 * j])
            p[long[live]] += 32
            k += 1
            live = live[left[live] > k]
        acc = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
        for x in v:
            acc = (acc ^ _round(np.zeros(len(long), U), x)) * _P1 + _P4
        h[long] = acc
    h += n.astype(U)
    zero = U(0)
    for _ in range(3):
        i = np.flatnonzero(e - p >= 8)
        if not len(i):
            break
        h[i] = _rot(h[i] ^ _round(np.full(len(i), zero), w8[p[i]]), 27) * _P1 + _P4
        p[i] += 8
    i = np.flatnonzero(e - p >= 4)
    h[i] = _rot(h[i] ^ (w4[p[i]].astype(U) * _P1), 23) * _P2 + _P3
    p[i] += 4
    for _ in range(3):
        i = np.flatnonzero(e > p)
        if not len(i):
            break
        h[i] = _rot(h[i] ^ (pad[p[i]].astype(U) * _P5), 11) * _P1
        p[i] += 1
    h = (h ^ (h >> U(33))) * _P2
    h = (h ^ (h >> U(29))) * _P3
    return h ^ (h >> U(32))


def ragged_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]], 0 for empty ranges."""
    out = np.zeros(len(off) - 1, values.dtype)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, off[full])
    return out
