"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Texts are taken together up to so many bytes; a longer one alone.
BYTES_AT_ONCE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, lower-case ASCII letters and all of a multi-byte character.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


@dataclass
class Words:
    """Words of ``n_docs`` texts: a 64-bit hash, the text and the byte range in ``raw`` (lower-cased) of each."""

    raw: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_docs: int

    def bounds(self) -> np.ndarray:
        """Where each text's words begin in the arrays, and the end."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = n if n > 4 * BYTES_AT_ONCE else max(n, 2 * BYTES_AT_ONCE)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        if size > 4 * BYTES_AT_ONCE:
            return made[0], made[1]  # of one very long text; not kept
        _powers = made[0], made[1]
    return _powers


def words_of(texts: list[str]) -> Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of whole texts after lower-casing A-Z."""
    coded = [t.encode() for t in texts]
    raw = _LOWER[np.frombuffer(b"\n".join([*coded, b""]), np.uint8)]
    inside = np.r_[False, _WORD[raw]].view(np.int8)
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1)
    return Words(raw, hashed, np.searchsorted(ends, start, "right"), start, end, len(texts))


def grouped(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) for runs of texts of bounded size together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BYTES_AT_ONCE:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]
