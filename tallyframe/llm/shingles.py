"""64-bit hashes of words and of word shingles, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = pow(int(_ODD), -1, 1 << 64)
_UP, _DOWN = _powers(int(_ODD), 4096), _powers(_INVERSE, 4096)


def _grown(n: int) -> None:
    global _UP, _DOWN
    if n > len(_UP):
        _UP, _DOWN = _powers(int(_ODD), 2 * n), _powers(_INVERSE, 2 * n)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash for each word."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    _grown(len(raw) + 1)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _UP[: len(raw)], dtype=np.uint64)))
    gaps = np.flatnonzero(raw == 32)
    start, end = np.concatenate(([0], gaps + 1)), np.append(gaps, len(raw))
    return mixed((upto[end] - upto[start]) * _DOWN[start])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def spotted_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of a text, as word_hashes() has it, and where it starts."""
    raw = np.frombuffer(text, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    turn = np.flatnonzero(space[1:] != space[:-1])
    start, end = turn[::2], turn[1::2]
    _grown(len(raw) + 1)
    upto = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _UP[: len(raw)], out=upto[1:])
    return mixed((upto[end] - upto[start]) * _DOWN[start]), start


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words; for fewer words, if any, one for all of them."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _ODD + words[k : n - width + 1 + k]
    return mixed(out)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The texts' words, in runs of texts of about CHUNK bytes, with the place of each run's first text."""
    first, some, held = 0, [], 0
    for k, text in enumerate(texts):
        some.append(text.split())
        held += len(text)
        if held >= CHUNK:
            yield first, some
            first, some, held = k + 1, [], 0
    if some:
        yield first, some


def hashed_words(texts: list[bytes]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """For each text its place, its words and their hashes."""
    for first, some in chunks(texts):
        hashes = word_hashes([w for words in some for w in words])
        at = 0
        for k, words in enumerate(some):
            yield first + k, words, hashes[at : at + len(words)]
            at += len(words)
