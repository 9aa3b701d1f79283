"""Word shingle sets and HyperMinHash registers, in numpy over a block of texts at a time."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Buckets of a sketch; a register holds 6 bits of leading zeros and 10 of mantissa, 0 meaning empty.
BUCKETS, MANTISSA = 256, 10
#: Chance at most, by which a pair at the threshold may share no band.
MISS = 5e-5

_rng = np.random.Generator(np.random.PCG64(20240229))
_byte = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_byte[ord("A") : ord("Z") + 1] = _byte[ord("a") : ord("z") + 1]
_base = np.uint64(0x9E3779B97F4A7C15)
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
#: For an empty bucket, the order in which others lend it their register.
PROBES = np.argsort(_rng.random((BUCKETS, BUCKETS)), axis=1).astype(np.int16)


def mix(h: np.ndarray) -> np.ndarray:
    """The published splitmix64 finalizer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """_base to the powers 0 to n - 1, modulo 2^64."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        with np.errstate(over="ignore"):
            out[have : have + more] = out[:more] * (out[have - 1] * _base)
        have += more
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of concatenated UTF-8 texts, A-Z lowered, and the number of words before each text's end."""
    blank = _space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's end ends its last word
    before = np.concatenate(([True], blank))
    starts = np.flatnonzero(~blank & (before[:-1] | edge[:-1]))
    ends = np.flatnonzero(~blank & (np.concatenate((blank[1:], [True])) | edge[1:])) + 1
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    # short words column by column; the few long ones one by one
    usual = np.flatnonzero(lengths <= 40)
    most = int(lengths[usual].max()) if len(usual) else 0
    order = usual[np.argsort(-lengths[usual], kind="stable")]
    at, left = starts[order], lengths[order]
    h = np.zeros(len(order), np.uint64)
    for k in range(most):
        n = int(np.searchsorted(-left, -k, side="left"))  # words longer than k
        h[:n] = h[:n] * _base + _byte[data[at[:n] + k]]
    out[order] = h
    for i in np.flatnonzero(lengths > 40):
        x = _byte[data[starts[i] : ends[i]]]
        out[i] = (x * _powers(len(x))[::-1]).sum(dtype=np.uint64)
    return mix(out + lengths.astype(np.uint64)), np.searchsorted(starts, offsets[1:], side="left")


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's SHINGLE-word shingles; of its whole word sequence if it has fewer words; none without words."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64)
    words, upto = word_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
    n = max(0, len(words) - SHINGLE + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    rolled = mix(rolled)
    out, start = [], 0
    for end in upto:
        if end - start >= SHINGLE:
            out.append(np.unique(rolled[start : end - SHINGLE + 1]))
        elif end > start:
            h = np.uint64(end - start)
            with np.errstate(over="ignore"):
                for w in words[start:end]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + w
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash sketch of sorted hashes: the top bits choose a bucket; the bucket keeps its least rest as leading zeros and mantissa."""
    out = np.zeros(BUCKETS, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = (hashes[first] << np.uint64(8)) | np.uint64(1)
    zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 62)
    body = (rest << zeros.astype(np.uint64)) << np.uint64(1)  # what follows the first set bit
    out[bucket[first]] = ((zeros + 1) << MANTISSA).astype(np.uint16) | (body >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    return out


def densified(sketch: np.ndarray) -> np.ndarray:
    """The sketch with empty buckets filled by the first full bucket in their probe order."""
    full = sketch > 0
    empty = np.flatnonzero(~full)
    if not len(empty) or len(empty) == BUCKETS:
        return sketch
    out = sketch.copy()
    probes = PROBES[empty]
    out[empty] = sketch[probes[np.arange(len(empty)), full[probes].argmax(1)]]
    return out


def band_rows(threshold: float) -> int:
    """Registers of a band: the most by which pairs of that Jaccard miss all bands with a chance of MISS at most."""
    return next((r for r in range(BUCKETS, 1, -1) if (1 - threshold**r) ** (BUCKETS // r) <= MISS), 1)


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of the bands of so many registers of each row of densified sketches; registers that fill no band are left out."""
    bands = BUCKETS // rows
    parts = np.zeros((len(sketches), bands, -(-rows // 4) * 4), np.uint16)
    parts[:, :, :rows] = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    parts = parts.view(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketches), bands)) * _base
    for k in range(parts.shape[2]):
        h = mix(h + parts[:, :, k]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h).view(np.int64)


#: Chance that two different register values of like buckets agree: the same leading zeros (1/3) and mantissa.
CHANCE = 1 / 3 / (1 << MANTISSA)


def likely(a: np.ndarray, b: np.ndarray, threshold: float, deviations: float = 4.5) -> np.ndarray:
    """Which row pairs of raw sketches may have that Jaccard: the estimate from buckets full in either, less chance agreement, is within some deviations."""
    either = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    share = (same / np.maximum(either, 1) - CHANCE) / (1 - CHANCE)
    return share >= threshold - deviations * np.sqrt(threshold * (1 - threshold) / np.maximum(either, 1))
