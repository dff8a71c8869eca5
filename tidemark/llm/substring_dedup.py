"""Removal of repeated word sequences, by prefix-partitioned suffix trees.

Sides of records of repeated windows (see windows.py) are dealt out over tasks by the
half that their windows share. In each task the suffixes that start at the anchors are
split by prefixes of as many words as it takes to make groups of at most `budget`
suffixes, up to the length of an anchor, which all repeats share; short prefixes share
a group. For each group one suffix tree is built, from its sorted suffixes and their
common prefixes. Its internal nodes as deep as the part of a window to the right of the
anchor are the repeats; ranks of the words to the left split them further, and every
window found at two places or more is removed at all of them. Where more than `most`
places share a half, the prefix takes in the whole window, whose subtree is one leaf:
its places are counted in Spark, by 128 bits of hash.

Null and empty texts have no words. Rows that repeat are documents of their own, so
their long passages go from all of them. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm import windows as win
from tidemark.llm.suffix_dedup import NO_ID, with_rid

WINDOW = 35
GRAM = 5
BUDGET = 4096
BLOCK = 6 << 20
MOST = 100_000  # places of one half that may meet in a task


def _found(texts: pa.Array, shape: win.Shape):
    """Words, row offsets, hashes of the words, and the sides of all records."""
    flat, offsets = tx.words(texts)
    codes, distinct = tx.coded(flat)
    h = tx.hashed(distinct)[codes]
    a, lo, hi = win.records(tx.windows_hash(h, shape.gram), offsets, shape)

    def half(at: np.ndarray) -> np.ndarray:
        return win.folded(h, at, np.full(len(at), shape.half))

    return flat, offsets, h, win.sides(half, half, a, lo, hi, np.searchsorted(offsets, a, side="right") - 1, shape)


def _keys(shape: win.Shape):
    def find(texts: pa.Array):
        *_, (_, _, _, rows, keys) = _found(texts, shape)
        return keys, rows

    return find


def _hit_sides(block: pa.Table, shape: win.Shape):
    """Words, offsets and the sides of the block whose halves occur again, but not too often."""
    flat, offsets, h, (a, lo, hi, rows, keys) = _found(tx.column(block, "text"), shape)
    hit = win.flagged(keys, rows, tx.column(block, "flags").to_pylist())
    hit[hit] = ~win.is_hot(keys[hit], rows[hit], tx.column(block, "hot").to_pylist())
    a, lo, hi, rows, keys = (x[hit] for x in (a, lo, hi, rows, keys))
    size = hi - lo + shape.length
    return flat, offsets, a, lo, size, rows, keys, win.kind_of(win.folded(h, lo, size), a - lo)


_NAMES = ("rid", "flags", "hot")


def _places(shape: win.Shape):
    """Where the sides are: rid, place of the anchor, kind."""

    def run(batches):
        for block in tx.blocks(win.inflated(batches, _NAMES), BLOCK):
            _, offsets, a, _, _, rows, _, kind = _hit_sides(block, shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(tx.column(block, "rid"))[rows]), pa.array((a - offsets[rows]).astype(np.int32)), pa.array(kind)], ["rid", "at", "kind"])

    return run


def _hot_windows(shape: win.Shape):
    """rid, place and 128 bits of hash of each window of a half that occurs too often."""

    def run(batches):
        for block in tx.blocks(win.inflated(batches, _NAMES), BLOCK):
            _, offsets, h, (_, lo, hi, rows, keys) = _found(tx.column(block, "text"), shape)
            hot = win.is_hot(keys, rows, tx.column(block, "hot").to_pylist())
            lo, n, rows = lo[hot], (hi - lo + 1)[hot], rows[hot]
            p = np.arange(int(n.sum())) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) if len(n) else np.zeros(0, np.int64)
            row, size = np.repeat(rows, n), np.full(len(p), shape.length)
            w = win.folded(h, p, size), win.folded(tx.mixed(h), p, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(tx.column(block, "rid"))[row]), pa.array((p - offsets[row]).astype(np.int32)), *[pa.array(x.view(np.int64)) for x in w]], ["rid", "at", "w0", "w1"])

    return run


_KINDS = "task int, before binary, n binary, content binary"


def _kinds(shape: win.Shape, tasks: int):
    """Distinct sides of a block by task, with the number of their places; contents are compressed together."""

    def run(batches):
        import zstandard

        pack, small = zstandard.ZstdCompressor(level=win.LEVEL).compress, win.narrow(shape)
        for block in tx.blocks(win.inflated(batches, _NAMES), BLOCK):
            flat, _, a, lo, size, _, keys, kind = _hit_sides(block, shape)
            _, first, n = np.unique(kind, return_index=True, return_counts=True)
            task = (keys[first] % np.uint64(tasks)).astype(np.int64)
            order = np.lexsort((keys[first], task))
            first, n, task = first[order], n[order], task[order]
            size, lo, before = size[first], lo[first], (a - lo)[first].astype(small)
            ends = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(int(ends[-1])) - np.repeat(ends[:-1] - lo, size)
            content = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(at))), " ")
            cuts = np.searchsorted(task, np.arange(tasks + 1))
            out = []
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
                s = slice(cuts[k], cuts[k + 1])
                out.append((int(k), before[s].tobytes(), pack(n[s].astype(np.uint32).tobytes()), pack("\n".join(content[s].to_pylist()).encode())))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), *[pa.binary()] * 3))], [x.split()[0] for x in _KINDS.split(", ")])

    return run


def _unpacked(pdf: pd.DataFrame, shape: win.Shape):
    """Kinds of a task, with places before the anchor, number of places, words (from 1 on) and where each kind's begin."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    before = np.frombuffer(b"".join(pdf["before"]), win.narrow(shape)).astype(np.int64)
    n = np.frombuffer(b"".join(map(unpack, pdf["n"])), np.uint32).astype(np.int64)
    flat, offsets = tx.words(pa.array([x for z in pdf["content"] for x in unpack(z).decode().split("\n")], pa.string()))
    codes, distinct = tx.coded(flat)
    kind = win.kind_of(win.folded(tx.hashed(distinct)[codes], offsets[:-1], np.diff(offsets)), before)
    kind, first, group = np.unique(kind, return_index=True, return_inverse=True)
    return kind, before[first], np.bincount(group, n, minlength=len(kind)), codes + 1, offsets[:-1][first], np.diff(offsets)[first]


def prefix_groups(right: np.ndarray, budget: int, most: int = GRAM) -> list[tuple[np.ndarray, int]]:
    """(suffixes, words that they share) of each group, in the order of their prefixes.

    Prefixes have at most `most` words, which all repeats share: none is cut apart.
    """
    out: list[tuple[np.ndarray, int]] = []
    todo = [(np.arange(len(right)), 0)]
    while todo:
        idx, depth = todo.pop()
        if len(idx) <= budget or depth == most:
            out.append((idx, depth))
            continue
        idx = idx[np.argsort(right[idx, depth], kind="stable")]
        s = right[idx, depth]
        cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])).tolist() + [len(idx)]
        parts, start = [], 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > budget:
                if start < a:
                    parts.append((idx[start:a], depth))
                parts.append((idx[a:b], depth + 1))
                start = b
            elif b - start > budget:
                parts.append((idx[start:a], depth))
                start = a
        if start < len(idx):
            parts.append((idx[start:], depth))
        todo += parts[::-1]
    return out


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Words that each sorted row shares with the one before; zeros pad the rows."""
    out = np.zeros(len(rows), np.int64)
    same = (rows[1:] == rows[:-1]) & (rows[1:] > 0)
    out[1:] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return out


def internal_nodes(lcp: np.ndarray) -> np.ndarray:
    """(depth, parent's depth, first leaf, end) of the suffix tree's internal nodes but the root."""
    out, stack = [], [(0, 0)]
    for i, depth in enumerate(lcp.tolist() + [0]):
        first = i - 1
        while stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((d, max(stack[-1][0], depth), first, i))
        if stack[-1][0] < depth:
            stack.append((depth, first))
    return np.array(out, np.int64).reshape(-1, 4)


def subtrees(right: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and the internal nodes of all groups' trees."""
    orders, nodes, at = [], [], 0
    for idx, _ in prefix_groups(right, budget):
        rows = right[idx]
        order = np.lexsort(rows.T[::-1])
        found = internal_nodes(common_prefixes(rows[order]))
        found[:, 2:] += at
        orders.append(idx[order])
        nodes.append(found)
        at += len(idx)
    return np.concatenate(orders), np.concatenate(nodes)


def _repeats(shape: win.Shape, budget: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, before, times, rank, at, size = _unpacked(pdf, shape)
        n, anchor = len(kind), at + before
        right = np.zeros((n, shape.length), np.int32)
        left = np.zeros((n, max(1, shape.offsets - 1)), np.int64)
        for i in range(shape.length):
            ok = before + i < size
            right[ok, i] = rank[anchor[ok] + i]
        for i in range(left.shape[1]):
            ok = before > i
            left[ok, i] = rank[anchor[ok] - i - 1]
        order, nodes = subtrees(right, budget)
        kind, before, left, times = kind[order], before[order], left[order], times[order]
        first = before - (size[order] - shape.length)

        def ids(r: int) -> np.ndarray:
            out = np.arange(n) + len(nodes)
            deep = np.flatnonzero((nodes[:, 0] >= r) & (nodes[:, 1] < r))
            span = nodes[deep, 3] - nodes[deep, 2]
            where = np.arange(int(span.sum())) + np.repeat(nodes[deep, 2] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) if len(deep) else np.zeros(0, np.int64)
            out[where] = np.repeat(deep, span)
            return out

        gone = np.zeros((n, shape.offsets + 2), np.int8)
        for o, at, group in win.groups_by_offset(shape, ids, left, first, before):
            gone[at, o + 1] = np.bincount(group, times[at])[group] >= 2
        step = np.diff(gone, axis=1)
        r, o0 = np.nonzero(step > 0)
        _, o1 = np.nonzero(step < 0)
        return pd.DataFrame({"kind": kind[r], "o0": o0, "o1": o1 - 1})

    return run


def spans(docs: DataFrame, texts: DataFrame, length: int = WINDOW, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """(rid, spans: array of first word, end) of the words to remove; docs: rid, doc_id, text; texts: the same compressed."""
    if length < GRAM:
        raise ValueError(f"windows of under {GRAM} words have no anchor")
    shape = win.Shape(length, GRAM)
    flags, hot_flags = win.flags(docs, _keys(shape), False, BLOCK, most)
    tasks = 2 * tx.shuffle_width(docs.sparkSession)
    hit = texts.join(flags, "rid").select("z", *_NAMES)
    found = hit.mapInArrow(_kinds(shape, tasks), _KINDS).groupBy("task").applyInPandas(_repeats(shape, budget), "kind long, o0 int, o1 int")
    places = hit.mapInArrow(_places(shape), "rid long, at int, kind long").join(found, "kind")
    each = places.select("rid", F.struct((F.col("at") - F.col("o1")).alias("s"), (F.col("at") - F.col("o0") + length).alias("e")).alias("x"))
    hot = texts.join(hot_flags, "rid").select("z", *_NAMES).mapInArrow(_hot_windows(shape), "rid long, at int, w0 long, w1 long")
    again = hot.groupBy("w0", "w1").agg(F.count("*").alias("n")).where("n > 1")
    each = each.unionByName(hot.join(again, ["w0", "w1"]).select("rid", F.struct(F.col("at").alias("s"), (F.col("at") + length).alias("e")).alias("x")))
    return each.groupBy("rid").agg(F.collect_set("x").alias("spans"))


def _kept(batches):
    """Words and kept words of each row."""
    for block in tx.blocks(win.inflated(batches, ("doc_id", "spans")), BLOCK):
        flat, offsets = tx.words(tx.column(block, "text"))
        keep = np.ones(len(flat), bool)
        for i, found in enumerate(tx.column(block, "spans").to_pylist()):
            for x in found or ():
                keep[offsets[i] + x["s"] : offsets[i] + x["e"]] = False
        ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(keep))), " ")
        n = np.diff(offsets)
        ids = tx.column(block, "doc_id")
        yield pc.if_else(pc.equal(ids, int(NO_ID)), pa.scalar(None, pa.int64()), ids), n, n - np.diff(ends), kept


def _digest(batches):
    for ids, n, removed, kept in _kept(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(removed), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept.to_pylist()], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _joined(docs: DataFrame, length: int, budget: int, most: int) -> DataFrame:
    docs = with_rid(docs)
    texts = win.compressed(docs)
    return texts.join(spans(docs, texts, length, budget, most), "rid", "left").select("doc_id", "z", "spans")


def digests(docs: DataFrame, length: int = WINDOW, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return _joined(docs, length, budget, most).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, length: int = WINDOW, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """(doc_id, kept): each row's remaining words, joined by one space."""

    def run(batches):
        for ids, _, _, kept in _kept(batches):
            yield pa.RecordBatch.from_arrays([ids, kept], ["doc_id", "kept"])

    return _joined(docs, length, budget, most).mapInArrow(run, "doc_id long, kept string")
