"""Repeated windows of a fixed number of symbols, for the two substring operators.

Each window is kept with its anchor: the k-gram of least hash in it (the leftmost of
equals), which two equal windows share at the same place. Consecutive windows with
one anchor form a record. A window of length L holds half of L on one side of its anchor,
so a record has two sides, the windows with a half from the anchor on and those with a
half before it, and equal windows share that half. `flags` counts the halves over
ranges of hashes. Sides whose half occurs nowhere else can't repeat and stay where they
are. The others are dealt out by their half, equal ones summed up before they move.
Windows of two sides are equal if they agree to the right of the anchor, which the
sorted suffixes at the anchors tell, and to the left of it, which ranks of the left
parts tell. A half that occurs more than a given number of times would fill a task: its
prefix grows to the whole window, so that counts by window, which Spark adds up
partially, take the place of a tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.ngram_join import from_planes, low_bits, planes, range_bounds

CHUNK = 1 << 19
LEVEL = 6  # of Zstandard: of texts and contents that move


@dataclass(frozen=True)
class Shape:
    """Length of a window and of an anchor."""

    length: int
    gram: int

    @property
    def half(self) -> int:
        return (self.length + 1) // 2

    @property
    def offsets(self) -> int:
        """Places that an anchor can have in a window."""
        return self.length - self.gram + 1


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys) - width + 1
    pad = -len(keys) % width
    full = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(full, axis=1).ravel()
    after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def records(grams: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each record; grams[i] is the hash of the k-gram at i of the flat symbols."""
    out: list[np.ndarray] = []
    width, n = shape.offsets, int(offsets[-1]) - shape.length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    valid = np.zeros(n, bool)
    delta = np.zeros(n + 1, np.int32)
    starts, ends = offsets[:-1], offsets[1:] - shape.length + 1
    rows = ends > starts
    np.add.at(delta, starts[rows], 1)
    np.add.at(delta, ends[rows], -1)
    valid = np.cumsum(delta[:-1]) > 0
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        part = grams[lo : hi + width - 1]
        keys = (part & np.uint64(0xFFFFFFFF00000000)) | np.arange(lo, lo + len(part), dtype=np.uint64)
        anchor = (_sliding_least(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        p = np.flatnonzero(valid[lo:hi])
        if not len(p):
            continue
        a = anchor[p]
        p = p + lo
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        out.append(np.stack([a[first], p[first], p[last]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    a, lo, hi = np.concatenate(out, axis=1)
    return a, lo, hi


def sides(right, left, anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, row, key) of the records' two sides.

    Windows that hold a half from the anchor on are of the right side, the others hold
    a half before it: a side's windows share that half, whose hash is its key.
    """
    most = shape.length - shape.half
    r, l = np.flatnonzero(anchors - hi <= most), np.flatnonzero(anchors - lo > most)
    a = np.concatenate([anchors[r], anchors[l]])
    first = np.concatenate([np.maximum(lo[r], anchors[r] - most), lo[l]])
    last = np.concatenate([hi[r], np.minimum(hi[l], anchors[l] - most - 1)])
    return a, first, last, np.concatenate([rows[r], rows[l]]), np.concatenate([right(anchors[r]), left(anchors[l] - shape.half)])


def _pack(find, parts: int, once_a_row: bool, max_bytes: int):
    def run(batches):
        block_no = TaskContext.get().partitionId() << 24
        for block in tx.blocks(batches, max_bytes):
            keys, rows = find(tx.column(block, "text"))
            order = np.lexsort((rows, keys)) if once_a_row else np.argsort(keys, kind="stable")
            keys, rows = keys[order], rows[order]
            if once_a_row and len(keys):
                new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])
                keys, rows = keys[new], rows[new]
            rids = np.asarray(tx.column(block, "rid")).astype(np.int64).tobytes()
            cuts = np.searchsorted(keys >> np.uint64(32), range_bounds(parts))
            low, own = low_bits(keys), block_no % parts
            data = [(block_no, p, planes(low[s:e]), rows[s:e].astype(np.uint16).tobytes(), rids if p == own else None) for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if s < e or p == own]
            block_no += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*data), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "part", "h", "d", "rids"])

    return run


def _again(most: int):
    """The keys of a range that occur twice or more, and those of them, with the range's number, that occur more than `most` times."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.uint64(int(pdf["part"].iloc[0]) << 32)
        hs = [from_planes(x, np.uint32) for x in pdf["h"]]
        u, n = np.unique(np.concatenate(hs), return_counts=True)
        twice, times = u[n > 1], n[n > 1]
        out = {k: [] for k in ("rows", "keys", "hot_rows", "hot_keys")}
        for x, d in zip(hs, pdf["d"]):
            d = np.frombuffer(d, np.uint16)
            at = np.minimum(np.searchsorted(twice, x), max(0, len(twice) - 1))
            hit = np.flatnonzero(twice[at] == x) if len(twice) else np.zeros(0, np.int64)
            hot = hit[times[at[hit]] > most]
            for k, v in zip(out, (d[hit], x[hit], d[hot], x[hot] | part)):
                out[k].append(v.tobytes())
        return pd.DataFrame({"block": pdf["block"], "rids": pdf["rids"], **out})

    return run


def _listed(rows, keys, kind: type) -> dict[int, bytes]:
    rows = np.concatenate([np.frombuffer(x, np.uint16) for x in rows])
    keys = np.concatenate([np.frombuffer(x, kind) for x in keys])
    order = np.argsort(rows, kind="stable")
    rows, keys = rows[order], keys[order]
    own = np.unique(rows)
    return dict(zip(own.tolist(), [x.tobytes() for x in np.split(keys, np.searchsorted(rows, own)[1:])])) if len(own) else {}


def _by_row(parts: int):
    """Lists of a block's rows; a list of hot halves begins with the number of ranges, by which `is_hot` numbers them again."""
    head = np.array([parts], np.uint64).tobytes()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rids = np.frombuffer(pdf.loc[pdf["rids"].notna(), "rids"].iloc[0], np.int64)
        found, hot = _listed(pdf["rows"], pdf["keys"], np.uint32), _listed(pdf["hot_rows"], pdf["hot_keys"], np.uint64)
        return pd.DataFrame({"rid": rids[list(found)], "flags": list(found.values()), "hot": [head + hot[i] if i in hot else None for i in found]})

    return run


def flags(docs: DataFrame, find, once_a_row: bool, max_bytes: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(rid, flags, hot) of the rows that have halves which occur again, and those of them with a hot one: one that occurs more than `most` times. find: texts -> (keys, rows)."""
    parts = min(tx.shuffle_width(docs.sparkSession), 1 << 16)
    packed = docs.select("rid", "text").mapInArrow(_pack(find, parts, once_a_row, max_bytes), "block long, part int, h binary, d binary, rids binary")
    counted = packed.groupBy("part").applyInPandas(_again(most), "block long, rids binary, rows binary, keys binary, hot_rows binary, hot_keys binary")
    found = tx.checkpoint(counted.groupBy("block").applyInPandas(_by_row(parts), "rid long, flags binary, hot binary"))
    # a half's key decides alone, so rows that repeat have equal flags
    once = lambda rows: rows.groupBy("rid").agg(F.first("flags").alias("flags"), F.first("hot").alias("hot"))
    return once(found), once(found.where("hot is not null"))


def compressed(docs: DataFrame) -> DataFrame:
    """rid, doc_id and each text as Zstandard bytes, for joins that move the texts."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = part.column(2).cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([pack(x) for x in texts], pa.binary())], ["rid", "doc_id", "z"])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, z binary")


def inflated(batches, rest: tuple[str, ...], rows: int = 500):
    """Batches with the column z turned back to text, some rows at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            cols = {n: part.column(part.schema.get_field_index(n)) for n in ("z", *rest)}
            texts = pa.array([unpack(x) for x in cols.pop("z").to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols.values(), texts], [*cols, "text"])


def flagged(keys: np.ndarray, rows: np.ndarray, flag_lists: list[bytes | None]) -> np.ndarray:
    """Which sides have a key among their row's flags."""
    sizes = [len(f or b"") // 4 for f in flag_lists]
    own = np.frombuffer(b"".join(f or b"" for f in flag_lists), np.uint32).astype(np.uint64)
    if not len(own):
        return np.zeros(len(keys), bool)
    own = np.sort(own | (np.repeat(np.arange(len(flag_lists)), sizes).astype(np.uint64) << np.uint64(32)))
    x = low_bits(keys).astype(np.uint64) | (rows.astype(np.uint64) << np.uint64(32))
    return own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x


def is_hot(keys: np.ndarray, rows: np.ndarray, hot_lists: list[bytes | None]) -> np.ndarray:
    """Which sides have a key among their row's hot ones, told by range and hash as when they were counted, so that all rows agree."""
    heads = [x[:8] for x in hot_lists if x]
    if not heads:
        return np.zeros(len(keys), bool)
    parts = int(np.frombuffer(heads[0], np.uint64)[0])
    sizes = [max(0, len(x or b"") // 8 - 1) for x in hot_lists]
    own = np.frombuffer(b"".join(x[8:] for x in hot_lists if x), np.uint64)
    own = np.sort(own | (np.repeat(np.arange(len(hot_lists)), sizes).astype(np.uint64) << np.uint64(48)))
    part = np.searchsorted(range_bounds(parts), keys >> np.uint64(32), side="right") - 1
    x = low_bits(keys).astype(np.uint64) | (part.astype(np.uint64) << np.uint64(32)) | (rows.astype(np.uint64) << np.uint64(48))
    return own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x


def folded(values: np.ndarray, lo: np.ndarray, size: np.ndarray, step: int = 1) -> np.ndarray:
    """Hash of values[lo], values[lo + step], ... (size of them) for each run; equal runs have equal hashes."""
    h = size.astype(np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        on = slice(None) if (full := size > k).all() else np.flatnonzero(full)
        x = (h[on] ^ values[lo[on] + k * step]) * np.uint64(0xD6E8FEB86659FD93)
        h[on] = x ^ (x >> np.uint64(32))
    return tx.mixed(h)


def kind_of(prints: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Key of a side, from its content's hash and the anchor's place in it."""
    return tx.mixed(prints ^ (before + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def narrow(shape: Shape) -> type:
    """The integers that hold the length of a side's content, which is under two windows."""
    return np.uint8 if 2 * shape.length <= 256 else np.uint32


def groups_by_offset(shape: Shape, right_ids, left: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Yields (offset, records, group of each): equal windows with the anchor at that offset.

    right_ids(r): an id for each record, equal if the first r symbols from the anchor are;
    left[:, i]: the rank of the symbol i + 1 places before the anchor; first and last:
    the offsets that each record has windows for.
    """
    rank = np.zeros(len(first), np.int64)
    for o in range(0, int(last.max()) + 1 if len(last) else 0):
        if o:
            rank = np.unique(rank * (int(left[:, o - 1].max()) + 2) + left[:, o - 1] + 1, return_inverse=True)[1]
        at = np.flatnonzero((first <= o) & (o <= last))
        if len(at):
            ids = right_ids(shape.length - o)[at]
            _, group = np.unique(ids * (int(rank.max()) + 1) + rank[at], return_inverse=True)
            yield o, at, group


def union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([int(s), int(e)])
    return [(s, e) for s, e in out]
