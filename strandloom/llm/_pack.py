"""Small binary columns: several integer arrays in one compressed value."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays (any numeric dtype) stored byte plane by byte plane, without the planes that are zero above, then compressed."""
    parts = [struct.pack("<H", len(arrays))]
    for a in arrays:
        u = np.ascontiguousarray(a).view(f"u{a.dtype.itemsize}")
        planes = (int(u.max()).bit_length() + 7) // 8 if u.size else 0
        parts.append(struct.pack("<3sBq", a.dtype.str.encode()[-3:].rjust(3), planes, a.size))
        parts += [(u >> u.dtype.type(8 * k)).astype(np.uint8) if k else u.astype(np.uint8) for k in range(planes)]
    return zstandard.compress(b"".join(parts), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    count, at, out = struct.unpack_from("<H", raw)[0], 2, []
    for _ in range(count):
        kind, planes, size = struct.unpack_from("<3sBq", raw, at)
        at += struct.calcsize("<3sBq")
        dtype = np.dtype(kind.decode().strip())
        u = np.zeros(size, f"u{dtype.itemsize}")
        for k in range(planes):
            plane = np.frombuffer(raw, np.uint8, size, at)
            u |= plane.astype(u.dtype) << u.dtype.type(8 * k) if k else plane
            at += size
        out.append(u.view(dtype))
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same non-negative integers in 32 bits where they fit."""
    return a.astype(np.uint32) if not a.size or int(a.max()) < 2**32 else a.astype(np.uint64)


def gaps(a: np.ndarray) -> np.ndarray:
    """First value, then differences, of an ascending unsigned array."""
    return np.diff(a, prepend=np.zeros(1, a.dtype)) if a.size else a


def from_gaps(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)
