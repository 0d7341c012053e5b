"""Numpy helpers on letters packed two bits each, for use inside Arrow tasks.

Letters are coded A=0, C=1, G=2, T=3 in either case; anything else is NONE and breaks a window.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

NONE = 4
CODE = np.full(256, NONE, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i


def joined_codes(seqs: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts with one NONE after each, and where each text starts (one more entry at the end).

    A character outside ASCII counts as one position and as no letter.
    """
    texts = [s or "" for s in seqs]
    raw = ("\n".join(texts) + "\n").encode("ascii", "replace") if texts else b""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(s) + 1 for s in texts), np.int64, len(texts)), out=starts[1:])
    return CODE[np.frombuffer(raw, np.uint8)], starts


def windows(codes: np.ndarray, k: int, dtype=np.uint64) -> np.ndarray:
    """The k letters from each position on as one number; k <= 32 for uint64, 16 for uint32.

    Windows that hold a NONE have no meaning; ``whole`` tells them.
    """
    part = codes.astype(dtype) & dtype(3)
    return _doubled(part, k, lambda left, right, n, m: (left << dtype(2 * m)) | right)


def reverse_windows(codes: np.ndarray, k: int, dtype=np.uint64) -> np.ndarray:
    """The reverse complement of the k letters from each position on as one number."""
    part = dtype(3) - (codes.astype(dtype) & dtype(3))
    return _doubled(part, k, lambda left, right, n, m: (right << dtype(2 * n)) | left)


def _doubled(part, k, glue):
    """Windows of k from windows of 1, 2, 4, ...; glue(left, right, letters left, letters right)."""
    total, have, size, want = None, 0, 1, k
    while want:
        if want & 1:
            if total is None:
                total, have = part, size
            else:
                n = max(0, min(len(total), len(part) - have))
                total = glue(total[:n], part[have : have + n], have, size)
                have += size
        want >>= 1
        if want:
            n = max(0, len(part) - size)
            part = glue(part[:n], part[size : size + n], size, size)
            size *= 2
    return total


def whole(codes: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k consist of letters only."""
    n = max(0, len(codes) - k + 1)
    bad = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(codes == NONE, out=bad[1:])
    return bad[k : k + n] == bad[:n]


def canonical(codes: np.ndarray, k: int, dtype=np.uint64) -> np.ndarray:
    """The smaller of each window and its reverse complement."""
    return np.minimum(windows(codes, k, dtype), reverse_windows(codes, k, dtype))


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (multiply and shift, twice)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def unmix64(x: np.ndarray) -> np.ndarray:
    """What ``mix64`` scrambled."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
        x ^= x >> np.uint64(29) ^ x >> np.uint64(58)
        x *= np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        x ^= x >> np.uint64(32)
    return x


def mix32(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 32-bit numbers."""
    x = x.astype(np.uint32, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
    return x


def pack(codes: np.ndarray) -> bytes:
    """Four letters a byte; the last byte is filled up with A."""
    c = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    c[: len(codes)] = codes & 3
    c = c.reshape(-1, 4)
    return (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).tobytes()


_FOUR = np.array([[b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3] for b in range(256)], np.uint8)


def unpack(data: bytes, n: int) -> np.ndarray:
    """The first n letters of what ``pack`` made."""
    return _FOUR[np.frombuffer(data, np.uint8)].reshape(-1)[:n]


def reverse_complement(x: np.ndarray, k: int) -> np.ndarray:
    """The reverse complement of windows of k <= 32 letters, as uint64."""
    x = ~x
    two, four = np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
    x = (x >> np.uint64(2) & two) | (x & two) << np.uint64(2)
    x = (x >> np.uint64(4) & four) | (x & four) << np.uint64(4)
    return x.byteswap() >> np.uint64(64 - 2 * k)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each position on."""
    out, size = x, 1
    while size < n:
        step = min(size, n - size)
        out = np.minimum(out[: len(out) - step], out[step:])
        size += step
    return out
