"""crc32 of concatenations from the parts' crc32, in numpy.

crc32(a + b) = shift(crc32(a), len(b)) xor crc32(b), where shift multiplies by x^(8 len(b)) modulo
the CRC-32 polynomial (published: zlib's crc32_combine). Bits are reflected: x^0 is the top bit.
"""

from __future__ import annotations

import zlib

import numpy as np

POLY = np.uint32(0xEDB88320)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo POLY, element by element."""
    a, b = a.astype(np.uint32), b.astype(np.uint32).copy()
    out = np.zeros_like(a)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0)).astype(np.uint32)
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ POLY, b >> np.uint32(1)).astype(np.uint32)
    return out


def _powers() -> list[np.uint32]:
    """x^(8 * 2^k) for k from 0 to 39."""
    out = [np.array([1 << 23], np.uint32)]
    for _ in range(39):
        out.append(multiply(out[-1], out[-1]))
    return [x[0] for x in out]


POWERS = _powers()


def combine_shift(crcs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Each crc's share in the crc of the whole, where after bytes follow its part."""
    out, after = crcs.astype(np.uint32), after.astype(np.int64)
    distinct, back = np.unique(after, return_inverse=True)
    factor = np.full(len(distinct), 1 << 31, np.uint32)
    for k, power in enumerate(POWERS):
        some = np.flatnonzero(distinct >> k & 1)
        if len(some):
            factor[some] = multiply(factor[some], np.full(len(some), power, np.uint32))
    return multiply(out, factor[back]) if len(out) else out


def crc_of_parts(parts: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(x) for x in parts], np.int64)
