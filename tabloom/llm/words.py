"""Words of texts as numpy arrays: runs of bytes 0-9, A-Z (as a-z), a-z and everything beyond ASCII.

All bytes of a character beyond ASCII count as word bytes, so working on UTF-8 bytes gives the same words as working
on characters. Words are known by 64-bit fingerprints.
"""

from __future__ import annotations

import numpy as np

from tabloom.llm.pretokens import mixed, span_hashes

STEP = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


class Words:
    """Fingerprints of the words of some texts, where they stand in the joined bytes, and where each text's words begin."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.bytes = b"\0".join(raw)
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
        self.text_at = np.cumsum(sizes) - sizes
        buffer = np.frombuffer(self.bytes, dtype=np.uint8)
        starts, ends, hashes = [], [], []
        at = 0
        while at < len(buffer):
            stop = min(at + STEP, len(buffer))
            while stop < len(buffer) and _WORD[buffer[stop]]:  # not inside a word
                ahead = np.flatnonzero(~_WORD[buffer[stop : stop + STEP]])
                stop = stop + int(ahead[0]) if len(ahead) else min(stop + STEP, len(buffer))
            part = buffer[at:stop]
            edge = np.diff(_WORD[part].astype(np.int8), prepend=0, append=0)
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(span_hashes(_LOWER[part], s, e))
            at = stop
        self.starts = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        self.bounds = np.searchsorted(self.starts, np.append(self.text_at, len(self.bytes) + 1))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of the `size` words from each place on, for the places where they fit."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mixed(out)


def minimizer_places(values: np.ndarray, window: int) -> np.ndarray:
    """For each `window` neighbours in a row the place of the least value; the last of equal ones. Places never fall."""
    n = len(values)
    if n <= window:
        return np.array([n - 1 - int(values[::-1].argmin())]) if n else np.zeros(0, dtype=np.int64)
    at = np.arange(n - window + 1)
    best, least = at.copy(), values[: len(at)].copy()
    for k in range(1, window):
        other = values[k : k + len(at)]
        less = other <= least
        least = np.where(less, other, least)
        best[less] = at[less] + k
    return best


def minimizers(values: np.ndarray, window: int) -> np.ndarray:
    """The different ones of these places. Any stretch of `window` values that occurs twice has one of them in common."""
    return np.unique(minimizer_places(values, window))
