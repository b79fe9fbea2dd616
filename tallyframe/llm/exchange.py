"""Cells of documents that exchange packed arrays: a row per sender and receiver instead of one per entry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cells, empty_text, partitions
from .shingles import mixed

#: Stands for a null doc_id: later than every other.
LAST = np.iinfo(np.int64).max
#: Partitions that cells are dealt to at most, so that neither driver nor shuffle has more blocks than it can track.
MOST_PARTITIONS = 20_000
#: Six bytes of a hash; what a receiver and a sender are called on the way to buckets and on the way to cells.
SIX, TO_CELL, TO_BUCKET = "V6", ("cell", "bucket", "block"), ("bucket", "cell", "block")


def schema(names: tuple[str, str, str]) -> str:
    return f"{names[0]} long, {names[1]} long, block binary"


def dealt(docs: DataFrame, carry: tuple[Column, ...] = ()) -> tuple[DataFrame, int]:
    """doc_id, text (bytes), cell and columns to carry of each row, partitioned by cell, and how many cells there are.

    A cell holds about CELL_BYTES whatever the input's size; partitions hold several cells once there are MOST_PARTITIONS.
    """
    many = max(cells(docs), partitions(docs))
    text = F.encode(empty_text(), "UTF-8").alias("text")
    cell = F.pmod(F.xxhash64("doc_id", "text", F.lit("cell")), F.lit(many)).alias("cell")
    more = [c.alias(f"carried {k}") for k, c in enumerate(carry)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, cell, *more).repartition(min(many, MOST_PARTITIONS), "cell"), many


def ranked(cell: pa.Table) -> list[int]:
    """The rows of a cell in an order that every pass finds again: by doc_id, nulls last, then by text."""
    ids, texts = cell["doc_id"].to_pylist(), cell["text"].to_pylist()
    return sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k], texts[k]))


def opened(cell: pa.Table) -> tuple[list[int], list[bytes]]:
    """doc_ids and texts of a cell, in an order that every pass finds again."""
    order, ids, texts = ranked(cell), cell["doc_id"].to_pylist(), cell["text"].to_pylist()
    return [LAST if ids[k] is None else ids[k] for k in order], [texts[k] for k in order]


def nothing(names: tuple[str, str, str]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], list(names))


def blocks(names: tuple[str, str, str], to: np.ndarray, own: int, arrays: tuple[np.ndarray, ...]) -> pa.Table:
    """A row for each value of `to`, with the arrays' entries for it; the arrays are ordered by it."""
    if not len(to):
        return nothing(names)
    cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    ends = np.append(cut[1:], len(to))
    packed = [b"".join((int(e - s).to_bytes(4, "little"), *(np.ascontiguousarray(a[s:e]).tobytes() for a in arrays))) for s, e in zip(cut, ends, strict=True)]
    return pa.Table.from_arrays([pa.array(to[cut], pa.int64()), pa.array(np.full(len(cut), own), pa.int64()), pa.array(packed, pa.binary())], list(names))


def unblocked(block: bytes, kinds: list) -> list[np.ndarray]:
    n, at, out = int.from_bytes(block[:4], "little"), 4, []
    for kind in kinds:
        kind = np.dtype(kind)
        out.append(np.frombuffer(block, kind, n, at))
        at += n * kind.itemsize
    return out


def gathered(rows: pa.Table, kinds: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sender of each entry of all blocks, and the entries."""
    parts = [unblocked(b, kinds) for b in rows["block"].to_pylist()]
    sender = np.repeat(rows[rows.schema.names[1]].to_numpy(), [len(p[0]) for p in parts])
    return sender, [np.concatenate([p[k] for p in parts]) for k in range(len(kinds))]


def six(h: np.ndarray) -> np.ndarray:
    """The upper 6 bytes of each hash."""
    return np.ascontiguousarray((h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def eight(short: np.ndarray) -> np.ndarray:
    """Numbers from 6 bytes each."""
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :6] = np.ascontiguousarray(short).view(np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def announced(buckets: int, own: int, doc: np.ndarray, h: np.ndarray) -> pa.Table:
    """A cell's distinct hashes, with how many of its documents have them (255: or more), by bucket."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    h = h[new]
    cut = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    many = np.minimum(np.diff(np.append(cut, len(h))), 255).astype(np.uint8)
    h = h[cut]
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return blocks(TO_BUCKET, bucket[order], own, (six(h[order]), many[order]))


def shared_by(least: int):
    """To each cell those of a bucket's hashes that `least` documents have (255 at most)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cell, (short, many) = gathered(rows, [SIX, np.uint8])
        h = eight(short)
        _, which = np.unique(h, return_inverse=True)
        hit = np.bincount(which, many)[which] >= least
        h, cell = h[hit], cell[hit]
        order = np.argsort(cell, kind="stable")
        return blocks(TO_CELL, cell[order], key[0].as_py(), (six(h[order] << np.uint64(16)),))

    return run


def distinct(rows: np.ndarray, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal rows together (within equal `by`, which it follows), where each run starts, each row's run.

    Rows are compared byte by byte; their hash only brings equal ones together.
    """
    n, size = len(rows), rows.dtype.itemsize
    raw = np.zeros((n, -(-size // 8) * 8), np.uint8)
    raw[:, :size] = np.ascontiguousarray(rows).view(np.uint8).reshape(n, size)
    words = raw.view("<u8")
    h = np.zeros(n, np.uint64)
    for k in range(words.shape[1]):
        h = mixed(h ^ words[:, k])
    order = np.argsort(h) if by is None else np.lexsort((h, by))
    words = words[order]
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]).any(1)
    if by is not None:
        new[1:] |= by[order[1:]] != by[order[:-1]]
    cut = np.flatnonzero(new)
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(new) - 1
    return order, cut, which
