"""Suffix-array dedup: removal of byte strings that an earlier document holds.

Every string of `least` bytes has an anchor, the place in it whose next GRAM bytes hash lowest, and equal strings have
equal anchors. Documents are dealt into cells. Cells exchange, in blocks by hash, first which texts an earlier document
has as a whole, which then stand aside, next the hashes of the others' anchors, then the surroundings of those anchors that more than one document has, each distinct one once with its least
document. Equal strings meet in one block, where a Burrows-Wheeler transform of the surroundings tells which of their
suffixes share `least` bytes. What an earlier document holds goes back to the cells as spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .bwt import shared
from .common import table
from .exchange import LAST, SIX, TO_BUCKET, TO_CELL, announced, blocks, dealt, distinct, eight, gathered, nothing, opened, schema, shared_by, unblocked
from .shingles import mixed

LEAST, GRAM = 50, 20
#: Bytes that are hashed at a time; longer texts are cut into overlapping slices.
SLICE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def _slices(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about SLICE bytes with, for each piece in it, its text, its place there, and its place in the buffer."""
    some: list[bytes] = []
    what: list[tuple[int, int]] = []
    held = 0

    def out():
        owner, there = np.array(what, np.int64).T
        return np.frombuffer(b"".join(some), np.uint8), owner, there, np.cumsum([0, *map(len, some)])

    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - least + 1), SLICE):
            part = text[at : at + SLICE + least - 1]
            if len(part) < least:
                continue
            some.append(part)
            what.append((k, at))
            held += len(part)
            if held >= SLICE:
                yield out()
                some, what, held = [], [], 0
    if some:
        yield out()


def anchors(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and hash of every anchor."""
    gram = min(GRAM, least)
    width = least - gram + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for raw, owner, there, starts in _slices(texts, least):
        h, span, power = raw.astype(np.uint64) + np.uint64(1), 1, _ODD
        parts, left = None, gram
        while left:  # binary powers: hash of gram bytes from hashes of 1, 2, 4, ...
            if left & 1:
                if parts is None:
                    parts, done, scale = h, span, power
                else:
                    n = len(raw) - done - span + 1
                    parts = parts[:n] * np.uint64(power) + h[done : done + n]
                    done, scale = done + span, scale * power & (1 << 64) - 1
            left >>= 1
            if left:
                n = len(h) - span
                h = h[:n] * np.uint64(power) + h[span : span + n]
                span, power = 2 * span, power * power & (1 << 64) - 1
        h = mixed(parts)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        done = 1
        while 2 * done <= width:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        if done < width:
            low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
        whole = np.ones(len(low), bool)  # windows that lie in one piece
        for e in starts[1:-1]:
            whole[e - least + 1 : e] = False
        mark = np.zeros(len(raw), bool)
        mark[(low[whole] & _PLACE).astype(np.int64)] = True
        at = np.flatnonzero(mark)
        piece = np.searchsorted(starts, at, "right") - 1
        found.append((owner[piece], there[piece] + at - starts[piece], h[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_TEXT = np.dtype([("low", "<u8"), ("high", "<u8")])


def _keys(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), _TEXT)


def _texts(buckets: int):
    """The distinct texts of a cell, each with its least document, by bucket."""

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        ids, texts = opened(cell)
        keys, first = np.unique(_keys(texts), return_index=True)  # texts are in order of doc_id
        bucket = (keys["low"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return blocks(TO_BUCKET, bucket[order], key[0].as_py(), (keys[order], np.array(ids, "<i8")[first[order]]))

    return run


def _least(key: tuple, rows: pa.Table) -> pa.Table:
    """To each cell the texts whose least document is in another."""
    cell, (keys, doc) = gathered(rows, [_TEXT, "<i8"])
    _, which = np.unique(keys, return_inverse=True)
    least = np.full(which.max() + 1, LAST)
    np.minimum.at(least, which, doc)
    hit = np.flatnonzero(least[which] < doc)
    hit = hit[np.argsort(cell[hit], kind="stable")]
    return blocks(TO_CELL, cell[hit], key[0].as_py(), (keys[hit], least[which[hit]]))


def _copies(ids: list[int], texts: list[bytes], named: pa.Table) -> np.ndarray:
    """Which texts a smaller doc_id has as a whole."""
    doc, keys = np.array(ids, np.int64), _keys(texts)
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    out = doc > doc[first[which]]
    if named.num_rows:
        theirs, least = gathered(named, [_TEXT, "<i8"])[1]
        at = np.argsort(theirs, order=("low", "high"))
        theirs, least = theirs[at], least[at]
        where = np.minimum(np.searchsorted(theirs, keys), len(theirs) - 1)
        out |= (theirs[where] == keys) & (least[where] < doc)
    return out


def _note(key: tuple, rows: np.ndarray) -> pa.Table:
    """What a cell tells itself, past the buckets."""
    own = key[0].as_py()
    return blocks(TO_BUCKET, np.full(len(rows), -1 - own), own, (rows.astype("<u4"),))


def _noted(found: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """What the cell told itself, and the rest."""
    mine = pa.compute.less(found["bucket"], 0)
    rows = found.filter(mine)
    return (gathered(rows, ["<u4"])[1][0].astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)), found.filter(pa.compute.invert(mine))


def _passed(key: tuple, rows: pa.Table) -> pa.Table:
    return pa.Table.from_arrays([rows["cell"], rows["bucket"], rows["block"]], list(TO_CELL))


def _announce(buckets: int, least: int):
    """A cell's distinct anchors, of texts that are no copies."""

    def run(key: tuple, cell: pa.Table, named: pa.Table) -> pa.Table:
        if not cell.num_rows:
            return nothing(TO_BUCKET)
        ids, texts = opened(cell)
        copies = np.flatnonzero(_copies(ids, texts, named))
        for k in copies:
            texts[k] = b""
        owner, _, h = anchors(texts, least)
        return pa.concat_tables([announced(buckets, key[0].as_py(), np.array(ids, np.int64)[owner], h), _note(key, copies)])

    return run


def _common(key: tuple, rows: pa.Table) -> pa.Table:
    return _passed(key, rows) if key[0].as_py() < 0 else shared_by(2)(key, rows)


def _pressed(block: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(block, asbytes=True)


def _kinds(least: int, gram: int) -> list:
    return [np.dtype([("bytes", np.uint8, 2 * least - gram), ("start", np.uint8), ("end", np.uint8)]), "<u4"]


def _unpressed(block: bytes) -> tuple[bytes, bytes]:
    size, pressed = int.from_bytes(block[:8], "little"), int.from_bytes(block[8:16], "little")
    return pa.Codec("zstd", 1).decompress(block[16 : 16 + pressed], size, asbytes=True), block[16 + pressed :]


def _surround(buckets: int, least: int):
    """A cell's distinct surroundings of common anchors, by bucket, with who has them where."""
    gram = min(GRAM, least)
    width = least - gram + 1
    reach = np.arange(1 - width, least)
    head = _kinds(least, gram)

    def run(key: tuple, cell: pa.Table, found: pa.Table) -> pa.Table:
        if not cell.num_rows:
            return nothing(TO_BUCKET)
        ids, texts = opened(cell)
        copies, wanted = _noted(found)
        whole = [k for k in copies if len(texts[k]) >= least]
        note = _note(key, np.array(whole, np.int64))
        for k in copies:
            texts[k] = b""
        if not wanted.num_rows:
            return note
        owner, at, h = anchors(texts, least)
        hit = np.isin(h >> np.uint64(16), np.unique(eight(gathered(wanted, [SIX])[1][0])))
        owner, at, h = owner[hit], at[hit], h[hit]
        if not len(h):
            return note
        starts = np.cumsum([0, *map(len, texts)])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        lens = np.diff(starts)[owner]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        what = np.zeros(len(h), head[0])
        for s in range(0, len(h), 50_000):
            e = slice(s, s + 50_000)
            place = at[e, None] + reach
            inside = (place >= 0) & (place < lens[e, None])
            what["bytes"][e] = np.where(inside, raw[np.clip(starts[owner[e], None] + place, 0, len(raw) - 1)], 0)
        what["start"] = np.maximum(0, width - 1 - at)
        what["end"] = np.minimum(len(reach), lens - at + width - 1)
        order, cut, which = distinct(what, bucket)
        around, to = what[order[cut]], bucket[order[cut]]
        many = np.diff(np.append(cut, len(order))).astype("<u4")
        heads = blocks(TO_BUCKET, to, key[0].as_py(), (around, many))
        tails = blocks(TO_BUCKET, bucket[order], key[0].as_py(), (owner[order].astype("<u4"), np.array(ids, "<i8")[owner[order]], at[order].astype("<i8")))
        both = [_pressed(a) for a in heads["block"].to_pylist()]
        both = [b"".join((len(a).to_bytes(8, "little"), len(z).to_bytes(8, "little"), z, b)) for a, z, b in zip(heads["block"].to_pylist(), both, tails["block"].to_pylist(), strict=True)]
        return pa.concat_tables([heads.set_column(2, "block", pa.array(both, pa.binary())), note])

    return run


def _twice(rows: np.ndarray, start: int, end: int) -> np.ndarray:
    """Which rows have these columns in common with another."""
    part = np.ascontiguousarray(rows[:, start:end]).view(f"V{end - start}").ravel()
    _, cut, which = distinct(part)
    return np.diff(np.append(cut, len(part)))[which] > 1


def _search(least: int):
    """To each cell the spans of its documents that an earlier document holds."""
    gram = min(GRAM, least)
    width = least - gram + 1
    head = _kinds(least, gram)

    def run(key: tuple, sent: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return _passed(key, sent)
        raw = [_unpressed(b) for b in sent["block"].to_pylist()]
        heads = [unblocked(a, head) for a, _ in raw]
        tails = [unblocked(b, ["<u4", "<i8", "<i8"]) for _, b in raw]
        around = np.concatenate([x[0] for x in heads])
        owner, doc, at = (np.concatenate([x[k] for x in tails]) for k in range(3))
        cell = np.repeat(sent["cell"].to_numpy(), [len(x[0]) for x in tails])
        order, cut, which = distinct(around)
        rows = around[order[cut]]
        row = np.repeat(which, np.concatenate([x[1] for x in heads]))
        first = np.full(len(rows), LAST)
        np.minimum.at(first, row, doc)
        start, end = rows["start"].astype(np.int64), rows["end"].astype(np.int64)
        best = np.repeat(first[:, None], width, 1)
        # A string of `least` bytes reaches half of its rest or more to one side of its anchor; others can share none.
        half = (least - gram + 1) // 2
        some = np.flatnonzero(_twice(rows["bytes"], width - 1, width - 1 + gram + half) | _twice(rows["bytes"], width - 1 - half, width - 1 + gram))
        if len(some):
            col = np.arange(2 * least - gram + 1)
            symbols = np.zeros((len(some), len(col)), np.uint16)
            symbols[:, :-1] = rows["bytes"][some].astype(np.uint16) + 1
            symbols[(col < start[some, None]) | (col >= end[some, None])] = 0
            r, c, kind = shared(symbols, start[some], end[some], least)
            cut = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
            low = np.minimum.reduceat(first[some[r]], cut)
            best[some[r], c] = np.repeat(low, np.diff(np.append(cut, len(kind))))
        o = np.arange(width)
        valid = (o >= start[:, None]) & (o + least <= end[:, None])
        turn = np.ones(best.shape, bool)
        turn[:, 1:] = (best[:, 1:] != best[:, :-1]) | (valid[:, 1:] != valid[:, :-1])
        k, o1 = np.nonzero(turn)
        o2 = np.append(o1[1:], 0)
        o2[np.append(k[1:] != k[:-1], True)] = width
        ok = valid[k, o1]
        k, o1, o2, low = k[ok], o1[ok], o2[ok], best[k[ok], o1[ok]]
        runs = np.bincount(k, minlength=len(rows))
        begin = np.cumsum(runs) - runs
        times = runs[row]
        occ = np.repeat(np.arange(len(row)), times)
        run_ = begin[row][occ] + np.arange(len(occ)) - np.repeat(np.cumsum(times) - times, times)
        hit = doc[occ] > low[run_]
        occ, run_ = occ[hit], run_[hit]
        base = at[occ] - (width - 1)
        order = np.argsort(cell[occ], kind="stable")
        return blocks(TO_CELL, cell[occ][order], key[0].as_py(), (owner[occ][order].astype("<u4"), (base + o1[run_])[order].astype("<i8"), (base + o2[run_] - 1 + least)[order].astype("<i8")))

    return run


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, as maximal ones in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return list(zip(start[cut].tolist(), reach[np.append(cut[1:], len(start)) - 1].tolist(), strict=True))


def _removed(key: tuple, cell: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a cell without what was found."""
    ids, texts = opened(cell)
    copies, found = _noted(found)
    spans: dict[int, list[tuple[int, int]]] = {int(k): [(0, len(texts[k]))] for k in copies}
    if found.num_rows:
        owner, start, end = gathered(found, ["<u4", "<i8", "<i8"])[1]
        order = np.argsort(owner, kind="stable")
        owner, start, end = owner[order], start[order], end[order]
        cut = np.flatnonzero(np.diff(owner.astype(np.int64), prepend=-1))
        for s, e in zip(cut, np.append(cut[1:], len(owner)), strict=True):
            spans[int(owner[s])] = merged(start[s:e], end[s:e])
    rows = []
    for k, text in enumerate(texts):
        gone = spans.get(k, [])
        at, kept = 0, []
        for s, e in gone:
            kept.append(text[at:s])
            at = e
        kept = b"".join([*kept, text[at:]])
        rows.append((None if ids[k] == LAST else ids[k], len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in gone], kept))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and kept (bytes) of each row of docs.

    A byte goes if a string of `least` bytes that covers it also starts in a row with a smaller doc_id. Null text:
    empty. A null doc_id is later than all others. Rows of one doc_id take nothing from each other. Texts shorter than
    `least` stay whole. Other columns are ignored. Empty table: no rows.
    """
    cells_, many = dealt(docs)
    by_cell = lambda: cells_.groupBy("cell")
    named = by_cell().applyInArrow(_texts(many), schema(TO_BUCKET)).groupBy("bucket").applyInArrow(_least, schema(TO_CELL))
    told = by_cell().cogroup(named.groupBy("cell")).applyInArrow(_announce(many, least), schema(TO_BUCKET))
    shared_ = told.groupBy("bucket").applyInArrow(_common, schema(TO_CELL))
    around = by_cell().cogroup(shared_.groupBy("cell")).applyInArrow(_surround(many, least), schema(TO_BUCKET))
    found = around.groupBy("bucket").applyInArrow(_search(least), schema(TO_CELL))
    return by_cell().cogroup(found.groupBy("cell")).applyInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("spans", "kept")
