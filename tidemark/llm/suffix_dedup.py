"""Suffix-array removal of byte strings that smaller documents also hold.

Sides of records of repeated windows (see windows.py) with the same half meet in one
task. There, the distinct strings from the anchors on become one text of 24-byte
symbols, whose suffix array (linear grouping, see suffix_sort.py) orders the sides;
common prefixes of neighbours cut the order into intervals of equal strings, and
together with ranks of the bytes before the anchors into groups of equal windows. Each
group has a least doc_id, and its windows are removed wherever the doc_id is larger.
Windows of a half that more than `most` rows have are grouped by 128 bits of hash in
Spark instead.

Null and empty texts have no bytes. A null doc_id is neither smaller nor larger than
any: such rows stay whole and remove nothing. Rows that repeat, and rows of one
doc_id, don't remove from each other. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm import windows as win
from tidemark.llm.suffix_sort import suffix_array

LENGTH = 50
GRAM = 8
SYMBOL = 24  # bytes, a multiple of eight
BLOCK = 6 << 20
MOST = 100_000  # rows with one half that may meet in a task
NO_ID = np.iinfo(np.int64).max


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and row offsets."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _eights(data: np.ndarray) -> np.ndarray:
    """Eight bytes at each place as an integer, zeros beyond the end."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for step in (1, 2, 4):
        x[:-step] |= x[step:] << np.uint64(8 * step)
    return x[: len(data)]


def _gram_hash(eights: np.ndarray) -> np.ndarray:
    h = eights * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def _half_hash(data: np.ndarray, eights: np.ndarray, half: int):
    def of(at: np.ndarray) -> np.ndarray:
        h = np.full(len(at), np.uint64(half))
        for i in range(0, half - 7, 8):
            h = tx.mixed(h * np.uint64(0x100000001B3) ^ eights[at + i])
        for i in range(half - half % 8, half):
            h = tx.mixed(h * np.uint64(0x100000001B3) ^ data[at + i])
        return h

    return of


def _found(texts: pa.Array, shape: win.Shape):
    """Bytes, row offsets, eights, and the sides of all records."""
    data, offsets = _bytes(texts)
    eights = _eights(data)
    a, lo, hi = win.records(_gram_hash(eights), offsets, shape)
    of = _half_hash(data, eights, shape.half)
    return data, offsets, eights, win.sides(of, of, a, lo, hi, np.searchsorted(offsets, a, side="right") - 1, shape)


def _keys(shape: win.Shape):
    def find(texts: pa.Array):
        *_, (_, _, _, rows, keys) = _found(texts, shape)
        return keys, rows

    return find


def prints(eights: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of size bytes from lo on: of each eight of them, and the last eight."""
    return tx.mixed(win.folded(eights, lo, size // 8, 8) ^ tx.mixed(eights[lo + size - 8] + size.astype(np.uint64)))


def _hit_sides(block: pa.Table, shape: win.Shape):
    """Bytes, offsets, eights and the sides of the block whose halves occur again, but not too often."""
    data, offsets, eights, (a, lo, hi, rows, keys) = _found(tx.column(block, "text"), shape)
    hit = win.flagged(keys, rows, tx.column(block, "flags").to_pylist())
    hit[hit] = ~win.is_hot(keys[hit], rows[hit], tx.column(block, "hot").to_pylist())
    a, lo, hi, rows, keys = (x[hit] for x in (a, lo, hi, rows, keys))
    size = hi - lo + shape.length
    return data, offsets, a, lo, size, rows, keys, win.kind_of(prints(eights, lo, size), a - lo)


_NAMES = ("rid", "doc_id", "flags", "hot")


def _places(shape: win.Shape):
    """Where the sides are: rid, doc_id, place of the anchor, kind."""

    def run(batches):
        for block in tx.blocks(win.inflated(batches, _NAMES), BLOCK):
            _, offsets, a, _, _, rows, _, kind = _hit_sides(block, shape)
            rid, doc = (np.asarray(tx.column(block, c)) for c in ("rid", "doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(rid[rows]), pa.array(doc[rows]), pa.array((a - offsets[rows]).astype(np.int32)), pa.array(kind)], ["rid", "doc_id", "at", "kind"])

    return run


def _hot_windows(shape: win.Shape):
    """rid, doc_id, place and 128 bits of hash of each window of a half that occurs too often."""

    def run(batches):
        for block in tx.blocks(win.inflated(batches, _NAMES), BLOCK):
            _, offsets, eights, (_, lo, hi, rows, keys) = _found(tx.column(block, "text"), shape)
            hot = win.is_hot(keys, rows, tx.column(block, "hot").to_pylist())
            lo, n, rows = lo[hot], (hi - lo + 1)[hot], rows[hot]
            p = np.arange(int(n.sum())) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) if len(n) else np.zeros(0, np.int64)
            row, size = np.repeat(rows, n), np.full(len(p), shape.length)
            w = prints(eights, p, size), prints(tx.mixed(eights), p, size)
            rid, doc = (np.asarray(tx.column(block, c)) for c in ("rid", "doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(doc[row]), pa.array((p - offsets[row]).astype(np.int32)), *[pa.array(x.view(np.int64)) for x in w]], ["rid", "doc_id", "at", "w0", "w1"])

    return run


_KINDS = "task int, before binary, least binary, further binary, size binary, content binary"


def _kinds(shape: win.Shape, tasks: int):
    """Distinct sides of a block by task, with their least and largest doc_id; contents are compressed together."""

    def run(batches):
        import zstandard

        pack, small = zstandard.ZstdCompressor(level=win.LEVEL).compress, win.narrow(shape)
        for block in tx.blocks(win.inflated(batches, _NAMES), BLOCK):
            data, _, a, lo, size, rows, keys, kind = _hit_sides(block, shape)
            doc = np.asarray(tx.column(block, "doc_id"))[rows]
            _, first, group = np.unique(kind, return_index=True, return_inverse=True)
            least, most = np.full(len(first), NO_ID), np.full(len(first), -(1 << 62))
            np.minimum.at(least, group, doc)
            known = doc < NO_ID
            np.maximum.at(most, group[known], doc[known])
            task = (keys[first] % np.uint64(tasks)).astype(np.int64)
            order = np.lexsort((keys[first], task))
            first, least, most, task = first[order], least[order], most[order], task[order]
            size, lo, before = size[first], lo[first], (a - lo)[first].astype(small)
            ends = np.concatenate([[0], np.cumsum(size)])
            flat = data[np.arange(int(ends[-1])) - np.repeat(ends[:-1] - lo, size)]
            cuts = np.searchsorted(task, np.arange(tasks + 1))
            out = []
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
                s = slice(cuts[k], cuts[k + 1])
                out.append((int(k), before[s].tobytes(), pack(least[s].tobytes()), pack((most[s] - least[s]).tobytes()), size[s].astype(small).tobytes(), pack(flat[ends[cuts[k]] : ends[cuts[k + 1]]].tobytes())))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), *[pa.binary()] * 5))], [x.split()[0] for x in _KINDS.split(", ")])

    return run


def _unpacked(pdf: pd.DataFrame, shape: win.Shape) -> pd.DataFrame:
    """One row for each kind of a task."""
    import zstandard

    unpack, small = zstandard.ZstdDecompressor().decompress, win.narrow(shape)
    size, before = (np.frombuffer(b"".join(pdf[c]), small).astype(np.int64) for c in ("size", "before"))
    raw = b"".join(map(unpack, pdf["content"]))
    least, further = (np.frombuffer(b"".join(map(unpack, pdf[c])), np.int64) for c in ("least", "further"))
    most, ends = least + further, np.concatenate([[0], np.cumsum(size)])
    kind = win.kind_of(prints(_eights(np.frombuffer(raw, np.uint8)), ends[:-1], size), before)
    u, first, group = np.unique(kind, return_index=True, return_inverse=True)
    low, high = np.full(len(u), NO_ID), np.full(len(u), -(1 << 62))
    np.minimum.at(low, group, least)
    np.maximum.at(high, group, most)
    content = [raw[s:e] for s, e in zip(ends[first].tolist(), ends[first + 1].tolist())]
    return pd.DataFrame({"kind": u, "before": before[first], "content": content, "least": low, "most": high})


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(len(parts), width)


def ordered(rights: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by the suffix array of the distinct ones' text, and common prefixes with the one before."""
    code, distinct = pd.factorize(np.array([*rights, None], dtype=object)[:-1])
    n, n_symbols = len(distinct), (width + SYMBOL - 1) // SYMBOL
    size = np.array([len(x) for x in distinct])
    raw = np.zeros((n, n_symbols * SYMBOL), np.uint8)
    raw[:, :width] = _padded(list(distinct), width)
    eights = raw.view(">u8").astype(np.uint64).reshape(n, n_symbols, -1)
    used = np.clip(size[:, None] - np.arange(n_symbols) * SYMBOL, 0, SYMBOL)
    there = used > 0
    # ranks of the symbols: by their bytes, then by their number
    keys = [used[there], *[eights[:, :, i][there] for i in range(SYMBOL // 8 - 1, -1, -1)]]
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    text = np.zeros((n, n_symbols + 1), np.int64)
    text[:, :-1][there] = rank
    count = there.sum(axis=1)
    starts = np.concatenate([[0], np.cumsum(count + 1)])
    place = np.full(int(starts[-1]), -1)
    place[starts[:-1]] = np.arange(n)
    order = place[suffix_array(text[np.arange(n_symbols + 1) <= count[:, None]])]
    order = order[order >= 0]
    same = raw[order[1:]] == raw[order[:-1]]
    lcp = np.where(same.all(axis=1), width, same.argmin(axis=1)) if n > 1 else np.zeros(0, np.int64)
    lcp = np.concatenate([[0], np.minimum(lcp, np.minimum(size[order[1:]], size[order[:-1]]))]).astype(np.int64)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    out = np.argsort(where[code], kind="stable")
    own = where[code[out]]
    again = np.concatenate([[False], own[1:] == own[:-1]])
    return out, np.where(again, size[code[out]], lcp[own])


def _least(shape: win.Shape):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _unpacked(pdf, shape)
        before, content = pdf["before"].to_numpy(), pdf["content"].tolist()
        order, lcp = ordered([c[b:] for c, b in zip(content, before)], shape.length)
        pdf = pdf.iloc[order].reset_index(drop=True)
        before, least, most = pdf["before"].to_numpy(), pdf["least"].to_numpy(), pdf["most"].to_numpy()
        size = pdf["content"].map(len).to_numpy()
        first = before - (size - shape.length)
        left = _padded([c[:b][::-1] for c, b in zip(pdf["content"], before)], max(1, int(before.max()))).astype(np.int64)
        value = np.full((len(pdf), shape.offsets + 2), -1, np.int64)
        for o, at, group in win.groups_by_offset(shape, lambda r: np.cumsum(lcp < r), left, first, before):
            low = np.full(int(group.max()) + 1, NO_ID)
            np.minimum.at(low, group, least[at])
            value[at, o + 1] = np.where(low[group] < most[at], low[group], -1)
        change = value[:, 1:] != value[:, :-1]
        r, c = np.nonzero(change)
        v = value[r, c + 1]
        last = np.append(c[1:], shape.offsets)
        ok = v >= 0
        # a run of one value ends where the next change of the same row is
        return pd.DataFrame({"kind": pdf["kind"].to_numpy()[r[ok]], "o0": c[ok], "o1": last[ok] - 1, "least": v[ok]})

    return run


def spans(docs: DataFrame, texts: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(rid, spans: array of start, end) of the bytes to remove; docs: rid, doc_id (NO_ID for none), text; texts: the same compressed."""
    if length < GRAM:
        raise ValueError(f"strings of under {GRAM} bytes have no anchor")
    shape = win.Shape(length, GRAM)
    flags, hot_flags = win.flags(docs, _keys(shape), True, BLOCK, most)
    tasks = 2 * tx.shuffle_width(docs.sparkSession)
    hit = texts.join(flags, "rid").select("z", *_NAMES)
    found = hit.mapInArrow(_kinds(shape, tasks), _KINDS).groupBy("task").applyInPandas(_least(shape), "kind long, o0 int, o1 int, least long")
    places = hit.mapInArrow(_places(shape), "rid long, doc_id long, at int, kind long").join(found, "kind")
    larger = (F.col("doc_id") > F.col("least")) & (F.col("doc_id") < int(NO_ID))
    each = places.where(larger).select("rid", F.struct((F.col("at") - F.col("o1")).alias("s"), (F.col("at") - F.col("o0") + length).alias("e")).alias("x"))
    hot = texts.join(hot_flags, "rid").select("z", *_NAMES).mapInArrow(_hot_windows(shape), "rid long, doc_id long, at int, w0 long, w1 long")
    least = hot.groupBy("w0", "w1").agg(F.min("doc_id").alias("least"))
    each = each.unionByName(hot.join(least, ["w0", "w1"]).where(larger).select("rid", F.struct(F.col("at").alias("s"), (F.col("at") + length).alias("e")).alias("x")))
    return each.groupBy("rid").agg(F.collect_set("x").alias("spans"))


def with_rid(docs: DataFrame) -> DataFrame:
    docs = tx.documents(docs)
    return docs.select(tx.row_key(docs).alias("rid"), F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "text")


def _kept(frames):
    """doc_id, bytes, runs to remove and what is left of each row."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for pdf in frames:
        for doc_id, z, found in zip(pdf["doc_id"], pdf["z"], pdf["spans"]):
            data, left, done = unpack(z), [], 0
            runs = win.union([x["s"] for x in found], [x["e"] for x in found]) if found is not None else []
            for s, e in runs:
                left.append(data[done:s])
                done = e
            yield None if doc_id == NO_ID else doc_id, len(data), runs, b"".join([*left, data[done:]])


def _joined(docs: DataFrame, length: int, most: int) -> DataFrame:
    docs = with_rid(docs)
    texts = win.compressed(docs)
    return texts.join(spans(docs, texts, length, most), "rid", "left").select("doc_id", "z", "spans")


def digests(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(frames):
        for pdf in frames:
            out = [(d, n, sum(e - s for s, e in runs), len(runs), hashlib.sha256(left).hexdigest()) for d, n, runs, left in _kept([pdf])]
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    return _joined(docs, length, most).mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(doc_id, kept binary): what is left of each row's bytes."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(d, left) for d, _, _, left in _kept([pdf])], columns=["doc_id", "kept"]).astype({"doc_id": "Int64"})

    return _joined(docs, length, most).mapInPandas(run, "doc_id long, kept binary")
