"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text hashed at once; a longer text is hashed in such pieces, cut at white space.
BLOCK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
_ODD = lambda n: _RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE = _ODD(256)
STEP = _ODD(1)[0]
PLACE = _ODD(WORDS)
SHORT = _ODD(WORDS)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, x))) for x in (STEP, inverse)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of the bytes, A-Z lower-cased."""
    raw = np.frombuffer(data.lower(), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _steps(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of about BLOCK bytes that end at white space."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for a text without words."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < BLOCK:
            size += len(texts[end]) + 1
            end += 1
        if end == at + 1:
            words = np.concatenate([word_hashes(p)[0] for p in _pieces(texts[at])] or [np.empty(0, np.uint64)])
            yield _set_of(words, _shingles(words))
        else:
            words, starts = word_hashes(b" ".join(texts[at:end]))
            bounds = np.cumsum([0] + [len(t) + 1 for t in texts[at:end]])
            cuts = np.searchsorted(starts, bounds)
            every = _shingles(words)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield _set_of(words[a:b], every[a : max(a, b - WORDS + 1)])
        at = end


def _shingles(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - WORDS + 1)
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += words[k : k + n] * PLACE[k]
    return mix(total)


def _set_of(words: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    if len(words) < WORDS:
        return mix(np.array([(words * SHORT[: len(words)]).sum() + np.uint64(len(words))], np.uint64))
    return np.unique(shingles)
