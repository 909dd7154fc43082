"""Word hashes of whole batches in a few array operations."""

from __future__ import annotations

import numpy as np

#: Bytes of a word after A-Z are lower-cased: ASCII letters and digits and all that is not ASCII; or all but white space.
IN_WORD = np.array([chr(x).isalnum() if x < 128 else True for x in range(256)])
NOT_BLANK = np.array([x != 32 and not 9 <= x <= 13 for x in range(256)])
SEGMENT = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(9))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64; kept for the longest asked for."""
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, base, np.uint64))]) if n > 1 else np.ones(1, np.uint64)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _segment(data: bytes, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    inside = in_word[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), dtype=np.uint64)])
    return mixed((total[ends] - total[starts]) * _power(_INVERSE, len(raw) + 1)[starts]), starts


def word_hashes(data: bytes, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, case of A-Z aside, and where it starts.

    A text is worked off in pieces of about ``SEGMENT`` bytes, cut at a byte
    outside of words, so that arrays stay small for texts of any length.
    """
    out, at = [], 0
    while at < len(data):
        end = at + SEGMENT
        while end < len(data) and in_word[data[end]]:
            end += 1
        h, starts = _segment(data[at:end], in_word)
        out.append((h, starts + at))
        at = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def batch_hashes(texts: list[bytes], in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the bounds of each text's words (one more than there are texts)."""
    h, starts = word_hashes(b"\n".join(texts), in_word)
    edges = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return h, np.searchsorted(starts, edges)
