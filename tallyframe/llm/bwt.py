"""Which suffixes of some strings share a prefix, from a Burrows-Wheeler transform of them."""

from __future__ import annotations

import numpy as np


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    flat = keys.ravel()
    order = np.argsort(flat)
    inside = flat[order]
    rank = np.empty(len(flat), np.int64)
    rank[order] = np.cumsum(np.append(False, inside[1:] != inside[:-1]))
    return rank.reshape(keys.shape)


def suffix_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The rank of every suffix of every row by its first symbols, more than depth of them; 0 after a row's end, else 1 to 256.

    Suffixes that share more than depth symbols may stand in any order: no border of depth or less lies between them,
    and what precedes them shares more than depth symbols with what precedes any other of them by the same symbol.
    """
    rows, width = symbols.shape
    key = np.zeros((rows, width), np.int64)
    for k in range(7):
        key[:, : width - k] |= symbols[:, k:].astype(np.int64) << (9 * (6 - k))
    rank, span = _dense(key), 7
    while span <= depth + 1 and span < width:
        key = rank * (int(rank.max()) + 2)
        key[:, : width - span] += rank[:, span:] + 1
        rank, span = _dense(key), 2 * span
    return rank


def shared(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and class of each suffix of the rows symbols[k, start[k]:end[k]] that has `least` symbols or more.

    Two are in one class if they share their first `least` symbols. Common prefixes come by increasing value: a border
    found at one value, extended backward by the transform, is a border one symbol deeper; places that no border has
    reached when the value is `least` share that much with their neighbour.
    """
    width = symbols.shape[1]
    col = np.arange(width)
    row, col = np.nonzero((col >= start[:, None]) & (col <= end[:, None]))  # the end itself is a suffix: the empty one
    rank = suffix_ranks(symbols, least)[row, col]
    order = np.argsort(rank.astype(np.int32))
    row, col = row[order], col[order]
    first = symbols[row, col]
    before = np.where(col > start[row], symbols[row, np.maximum(col - 1, 0)], 0).astype(np.uint16)
    back = np.argsort(before, kind="stable").astype(np.int32)  # place of the suffix one symbol shorter
    border = (first == 0) | np.append(True, first[1:] != first[:-1])
    new, open_ = np.flatnonzero(border), np.flatnonzero(~border)
    low, high = back[open_ - 1], back[open_]  # between these a border must lie to reach an open place
    mark, upto = np.zeros(len(first), np.int32), np.empty(len(first), np.int32)
    for _ in range(1, least):
        if not len(new) or not len(open_):
            break
        mark[new] = 1
        np.cumsum(mark, out=upto)
        mark[new] = 0
        reached = upto[high] != upto[low]
        new = open_[reached]
        border[new] = True
        rest = ~reached
        open_, low, high = open_[rest], low[rest], high[rest]
    kind = np.cumsum(border)
    long = end[row] - col >= least
    return row[long], col[long], kind[long]
