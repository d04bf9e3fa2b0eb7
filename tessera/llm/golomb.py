"""Golomb-Rice coding of sorted unsigned integers."""

from __future__ import annotations

import struct

import numpy as np

STEP = 1 << 16


def encode(values: np.ndarray) -> bytes:
    """Sorted uint64 values as deltas: quotients by 2**k in unary, then the k low bits of each."""
    v = np.ascontiguousarray(values, np.uint64)
    if not len(v):
        return struct.pack("<QB", 0, 0)
    d = np.diff(v, prepend=np.uint64(0))
    mean = max(1.0, float(v[-1]) / len(v))
    k = min(56, max(0, int(np.log2(mean))))
    q = (d >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    head = np.packbits(unary).tobytes()
    low = b""
    if k:
        parts = []
        for i in range(0, len(d), STEP):  # STEP * k bits are whole bytes
            bits = np.unpackbits(d[i : i + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - k :]
            parts.append(np.packbits(bits).tobytes())
        low = b"".join(parts)
    return struct.pack("<QBQ", len(v), k, len(head)) + head + low


def decode(data: bytes) -> np.ndarray:
    n, k = struct.unpack_from("<QB", data)
    if not n:
        return np.empty(0, np.uint64)
    (size,) = struct.unpack_from("<Q", data, 9)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, 17)))[:n]
    d = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        at = 17 + size
        for i in range(0, n, STEP):
            m = min(STEP, n - i)
            took = (m * k + 7) // 8
            bits = np.unpackbits(np.frombuffer(data, np.uint8, took, at))[: m * k].reshape(m, k)
            wide = np.zeros((m, 64), np.uint8)
            wide[:, 64 - k :] = bits
            d[i : i + m] |= np.packbits(wide, axis=1).reshape(-1).view(">u8").astype(np.uint64)
            at += took
    return np.cumsum(d, dtype=np.uint64)
