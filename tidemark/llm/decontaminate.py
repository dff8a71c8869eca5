"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared in lower case with every run of other characters than
letters and digits as one space. An item of m characters that occurs with at most
e = rate * m edits shares at least m + 1 - q - q * e q-grams with the text in a band
of e + 1 neighbouring diagonals. Shared q-grams are counted in bands of twice that
width which overlap by half, bands that meet the bound are kept, and a banded
alignment decides. Items too short for long q-grams are searched with short ones.
An item for which no bound is positive is cut into e + 1 pieces, of which one must
occur unchanged: every band with a piece is aligned.

Items of fewer than `least` characters must occur as whole words: the place begins
and ends at an end of the text, at a space or beside a letter of a script that is
written without spaces. Their budget is the same, so that those of fewer than
1 / rate characters occur unchanged. With `alone` (0: off), items of fewer characters
than that, in a script with spaces, match only a text that has nothing else. Items
without letters and digits match nothing.

The items are the query set: they are sent to all tasks in blocks of at most
`block_chars` characters, every block against all rows. Null and empty texts match
nothing. Of places of an item that overlap or share a band the best one is given.
Repeated rows and repeated items match each by themselves. Of a row's
documents doc_id and text are read, of items item_id and text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

RATE = 0.1
GRAMS = (8, 4)
LEAST = 20
BLOCK_CHARS = 4_000_000
BLOCK = 3 << 20
FILTER_BITS = 22
SLOT_BITS = 21
#: Ranges of code points (from, to) of scripts without spaces between words: Thai and Lao, Burmese, Khmer, Chinese and Japanese.
UNSPACED = np.array([0x0E00, 0x0F00, 0x1000, 0x10A0, 0x1780, 0x1800, 0x2E80, 0xA4D0, 0xF900, 0xFB00, 0xFF66, 0xFFA0, 0x1B000, 0x1B170, 0x20000, 0x40000], np.uint32)
_HITS = "rid long, doc_id long, item_id long, start long, end long, edits int"


def normalised(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), " ")


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and row offsets."""
    lengths = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place, q a power of two."""
    h = codes.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < q and len(h) > step:
        h = (h[:-step] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[step:] + (h[:-step] >> np.uint64(29)))
        step *= 2
    return tx.mixed(h) if step >= q else np.zeros(0, np.uint64)


@dataclass
class Items:
    """Items that one q-gram length serves, and an index of their q-grams; whole: only whole words count; exact: those without edits."""

    q: int
    whole: bool
    exact: bool
    ids: np.ndarray
    texts: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray


def index(ids: list[int], texts: list[str], rate: float, grams=GRAMS, least: int = LEAST) -> list[Items]:
    if not 0 <= rate < 1:
        raise ValueError("rate must be at least 0 and below 1")
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in normalised(pa.array(texts, pa.string())).to_pylist()]
    edits, groups = [int(rate * len(c)) for c in codes], {}
    for i, (c, e) in enumerate(zip(codes, edits)):
        if not len(c):
            continue
        whole, exact = len(c) < least, len(c) < least and e == 0
        bound = {q: len(c) + 1 - q - q * e for q in grams}
        q = next((q for q in grams if not exact and (bound[q] > 4 or q == grams[-1] and bound[q] > 0)), None)
        if q:
            places, need = np.arange(len(c) + 1 - q), bound[q]
        else:
            piece = len(c) // (e + 1)
            q = 1 << (min(grams[0], piece).bit_length() - 1)
            places, need = np.arange(e + 1) * piece, 1
        groups.setdefault((q, whole, exact), []).append((i, places, need))
    out = []
    for (q, whole, exact), members in groups.items():
        mine = [i for i, _, _ in members]
        flat = np.concatenate([gram_hashes(codes[i], q)[at] for i, at, _ in members])
        item = np.repeat(np.arange(len(mine)), [len(at) for _, at, _ in members])
        place = np.concatenate([at for _, at, _ in members])
        order = np.argsort(flat, kind="stable")
        u, first = np.unique(flat[order], return_index=True)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(u >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        out.append(Items(q, whole, exact, np.array([ids[i] for i in mine]), [codes[i] for i in mine], np.array([edits[i] for i in mine]), np.array([n for _, _, n in members]), u, np.append(first, len(flat)), item[order], place[order], seen))
    return out


def bands(items: Items, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(row, item, first diagonal) of the bands with enough shared q-grams; diagonals are places in the row less places in the item."""
    h = gram_hashes(codes, items.q)
    at = np.flatnonzero(items.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + items.q <= offsets[row + 1]
    at, row = at[inside], row[inside]
    k = np.minimum(np.searchsorted(items.grams, h[at]), len(items.grams) - 1)
    hit = items.grams[k] == h[at]
    at, row, k = at[hit] - offsets[row[hit]], row[hit], k[hit]
    n = items.first[k + 1] - items.first[k]
    ends = np.cumsum(n)
    entry = np.arange(int(n.sum())) - np.repeat(ends - n - items.first[k], n)
    item, diagonal, row = items.item[entry], np.repeat(at, n) - items.place[entry], np.repeat(row, n)
    longest = max(map(len, items.texts))
    half = items.edits[item] + 1
    cell = (diagonal + longest) // half  # a band is two cells: this one and the next, or the one before
    span = int(cell.max()) + 2 if len(cell) else 1
    key = (row.astype(np.int64) * len(items.ids) + item) * span + cell
    # sums over hashed cells are no less than those of the cells, so what stays below the bound can go first
    slot = key & ((1 << SLOT_BITS) - 1)
    sums = np.bincount(slot, minlength=1 << SLOT_BITS)
    near = np.maximum(np.roll(sums, 1), np.roll(sums, -1)) + sums
    some = near[slot] >= items.bound[item]
    key, place = key[some], items.place[entry[some]]
    # a symbol of the item counts once in a cell, however often the text repeats it
    per = longest + 1
    _, dense = np.unique(key, return_inverse=True)
    order = np.unique(dense * per + place, return_index=True)[1]
    key, count = np.unique(key[order], return_counts=True)
    # a cell and its right neighbour together; the band before it begins at the left neighbour
    after = np.zeros(len(key), np.int64)
    joined = key[1:] == key[:-1] + 1
    after[:-1][joined] = count[1:][joined]
    pair, c = key // span, key % span
    item = (pair % len(items.ids)).astype(np.int64)
    ok = count + after >= items.bound[item]
    return np.column_stack([pair[ok] // len(items.ids), item[ok], c[ok] * (items.edits[item[ok]] + 1) - longest])


def parted(codes: np.ndarray) -> np.ndarray:
    """Whether a word ends on both sides of the symbol: spaces, and letters of scripts without spaces."""
    return (codes == 32) | (np.searchsorted(UNSPACED, codes, side="right") % 2 == 1)


def word_ends(text: np.ndarray) -> np.ndarray:
    """Whether a word may begin or end before each symbol of text, and after the last."""
    out, own = np.ones(len(text) + 1, bool), parted(text)
    out[1:-1] = own[1:] | own[:-1]
    return out


def align(item: np.ndarray, text: np.ndarray, first: int, width: int, most: int, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> tuple[int, int]:
    """Least edits of the item against any part of text on diagonals first to first + width, and where the part ends; any number beyond most stands for all. starts and ends tell at which places of text a part may begin and end."""
    m, n = len(item), len(text)
    k = np.arange(width)
    high = np.int32(1 << 20)
    row = np.zeros(width, np.int32)
    j = first + k  # place in text before the first symbol of the item
    row[(j < 0) | (j > n)] = high
    if starts is not None:
        row[~starts[np.clip(j, 0, n)]] = high
        row = (np.minimum.accumulate(row - k) + k).astype(np.int32)
        row[(j < 0) | (j > n)] = high
    for i in range(m):
        j = i + first + k
        ok = (j >= 0) & (j < n)
        same = np.zeros(width, bool)
        same[ok] = text[j[ok]] == item[i]
        new = np.where(ok, row + ~same, high)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        out = (j + 1 < 0) | (j + 1 > n)
        new[out] = high
        new = np.minimum.accumulate(new - k) + k
        new[out] = high
        row = new.astype(np.int32)
        if i % 16 == 15 and row.min() > most:
            return most + 1, 0
    if ends is not None:
        row[~ends[np.clip(m + first + k, 0, n)]] = high
    best = int(row.argmin())
    return int(row[best]), min(n, max(0, m + first + best))


def verified(items: Items, codes: np.ndarray, offsets: np.ndarray, found: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of the bands' best alignments within the budget."""
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for row, item, diagonal in found.tolist():
        text, e, pattern = codes[offsets[row] : offsets[row + 1]], int(items.edits[item]), items.texts[item]
        known = out.setdefault((row, item), [])
        free = word_ends(text) if items.whole else None
        edits, end = align(pattern, text, diagonal - e, 4 * e + 3, e, free, free)
        if edits <= e:
            back, length = align(pattern[::-1], text[:end][::-1], -e, 2 * e + 1, e, *((np.arange(end + 1) == 0, free[: end + 1][::-1]) if items.whole else ()))
            start, edits = end - length, min(edits, back)
            if known and start < known[-1][1]:  # of places that overlap, the better one stays
                if edits < known[-1][2]:
                    known[-1] = (start, end, edits)
            else:
                known.append((start, end, edits))
    return [(r, i, s, t, e) for (r, i), places in sorted(out.items()) for s, t, e in places]


def unchanged(items: Items, codes: np.ndarray, offsets: np.ndarray, found: np.ndarray, alone: int) -> list[tuple[int, int, int, int, int]]:
    """The same for items without edits that must be whole words; a band's first diagonal is where the item would begin."""
    row, item, start = found.T
    m = np.array([len(t) for t in items.texts])
    inside = (start >= 0) & (offsets[row] + start + m[item] <= offsets[row + 1])
    row, item, start = row[inside], item[inside], start[inside]
    at, end, own = offsets[row] + start, offsets[row] + start + m[item], np.append(parted(codes), True)
    ok = ((start == 0) | own[at - 1] | own[at]) & ((end == offsets[row + 1]) | own[end - 1] | own[end])
    barred = np.array([len(t) < alone and not parted(t).any() for t in items.texts])
    ok &= ~barred[item] | (start == 0) & (end == offsets[row + 1])
    row, item, start, at = row[ok], item[ok], start[ok], at[ok]
    texts = np.zeros((len(m), m.max()), np.uint32)
    for i, t in enumerate(items.texts):
        texts[i, : len(t)] = t
    for k in range(m.max()):
        ok = (k >= m[item]) | (codes[np.minimum(at + k, len(codes) - 1)] == texts[item, k])
        row, item, start, at = row[ok], item[ok], start[ok], at[ok]
    out: list[tuple[int, int, int, int, int]] = []
    for r, i, s in zip(row.tolist(), item.tolist(), start.tolist()):
        if not (out and out[-1][:2] == (r, i) and s < out[-1][3]):
            out.append((r, i, s, s + int(m[i]), 0))
    return out


def _search(shared, alone: int):
    def run(batches):
        for block in tx.blocks(batches, BLOCK):
            codes, offsets = code_points(normalised(tx.column(block, "text")))
            hits = []
            for items in shared.value:
                found = bands(items, codes, offsets)
                for row, item, s, t, e in unchanged(items, codes, offsets, found, alone) if items.exact else verified(items, codes, offsets, found):
                    hits.append((row, int(items.ids[item]), s, t, e))
            rows = np.array([h[0] for h in hits], np.int64)
            rid, doc = np.asarray(tx.column(block, "rid")), tx.column(block, "doc_id")
            yield pa.RecordBatch.from_arrays([pa.array(rid[rows], pa.int64()), doc.take(pa.array(rows)), *[pa.array([h[k] for h in hits], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int32()))]], ["rid", "doc_id", "item_id", "start", "end", "edits"])

    return run


def search(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, block_chars: int = BLOCK_CHARS, alone: int = 0) -> DataFrame:
    """(rid, doc_id, item_id, start, end, edits) of every place where an item occurs within its budget; places count in normalised text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    docs = tx.documents(docs)
    docs = docs.select("doc_id", "text", tx.row_key(docs).alias("rid"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // block_chars) + 1
    parts = []
    for i in range(n):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast(index([r.item_id for r in mine], [r.text for r in mine], rate, least=least))
        parts.append(docs.mapInArrow(_search(shared, alone), _HITS))
    return reduce(DataFrame.unionByName, parts)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, alone: int = 0) -> DataFrame:
    """The rows of docs in which no item occurs."""
    key = tx.private(docs, "row_key")
    hit = search(docs, benchmark, rate, alone=alone).select(F.col("rid").alias(key)).distinct()
    return docs.withColumn(key, tx.raw_key()).join(hit, key, "left_anti").drop(key)
