"""Bigram language model in Elias-Fano tries, learned from a corpus and scoring it.

A token is a word of the lower-cased text (A-Z only) or the text's end; the end also
is the context of a text's first word. With Dirichlet smoothing,
P(w | h) = (c(hw) + mu * (c(w) + 1) / (N + V + 1)) / (c(h) + mu), a distribution over
the V known words and one unknown. The numerator needs only counts of w, and as each
token of a text is once predicted and once context, the denominators of a text add up
over the same words. So what is known about a word meets in the one shard of its hash:
no table of all words is sent anywhere, and the tries grow with the corpus, shard by
shard. A word that would fill much of a shard goes as several, one for each class of
contexts, to as many shards; its whole count, which none of them has, is sent along. As
each of the `shards` counts gives at most 16 such words, their table has at most 24
entries for a shard.

A shard's trie has two levels: words, and the contexts seen before each (the order
of suffixes). Both are Elias-Fano sequences of hashes; pointers from words to their
contexts are another, monotone one. Log probabilities are quantised, one byte each
beside a 256-entry codebook. A context is looked up by successor search inside its
word's range, relative to the range's base. Levels are written as bytes, mapped from
a file that is unlinked at once, and queried in bulk.

Null and empty texts are the end alone. Repeated rows count and score each. Rows
with a null doc_id are learned from and are not held out. Only doc_id and text are
read.
"""

from __future__ import annotations

import json
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

MU = 300.0
CONTEXT_BITS = 40  # beside 24 bits for the words of a shard
SHARE = 8  # a word with more than 1 / SHARE of the tokens of a shard goes as several
FOLDS, HELD = 7, 2

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th one (from 0) of a byte.
_ONE_AT = np.array([([j for j in range(8) if i >> j & 1] + [0] * 8)[:8] for i in range(256)], np.uint8)
STEP = 8  # bytes of high bits for an entry of a directory


class EliasFano:
    """A monotone sequence of 64-bit integers in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = _POPCOUNT[high].reshape(-1, STEP).sum(axis=1, dtype=np.int64)
        self.ones_before = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
        self.zeros_before = (np.arange(len(ones) + 1) * (8 * STEP) - self.ones_before).astype(np.uint32)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = min(57, max(0, (top // max(n, 1)).bit_length() - 1))
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((int(at[-1]) if n else 0) // (8 * STEP) + 1) * 8 * STEP, np.uint8)
        bits[at] = 1
        low, packed, step = values & np.uint64((1 << low_bits) - 1), [], 1 << 16
        for i in range(0, n if low_bits else 0, step):
            part = np.ascontiguousarray(low[i : i + step], "<u8")
            packed.append(np.packbits(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits].ravel(), bitorder="little"))
        return cls(n, low_bits, np.concatenate([*packed, np.zeros(8, np.uint8)]), np.packbits(bits, bitorder="little"))

    def _select(self, before: np.ndarray, i: np.ndarray, ones: bool) -> np.ndarray:
        step = np.minimum(np.searchsorted(before, i.astype(np.uint32), side="right") - 1, len(before) - 2)
        rest = i - before[step]
        own = self.high.reshape(-1, STEP)[step]
        if not ones:
            own = ~own
        seen = np.cumsum(_POPCOUNT[own], axis=1, dtype=np.uint8)
        byte = np.minimum((seen <= rest[:, None]).sum(axis=1), STEP - 1)
        each = np.arange(len(i))
        rest = rest - np.where(byte > 0, seen[each, byte - 1], 0)
        return step * (8 * STEP) + byte * 8 + _ONE_AT[own[each, byte], np.clip(rest, 0, 7)]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        eights = np.ndarray(len(self.low) - 7, "<u8", self.low, strides=(1,))
        return (eights[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(self.ones_before, i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Position of each value, or -1: successor search inside the bucket of its high bits."""
        if not self.n:
            return np.full(len(x), -1)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        most = int(self.zeros_before[-1])
        inside = high < most
        high = np.minimum(high, most - 1)
        lo = np.where(high > 0, self._select(self.zeros_before, np.maximum(high - 1, 0), False) - (high - 1), 0)
        hi = np.minimum(self._select(self.zeros_before, high, False) - high, self.n)
        end, want = hi.copy(), x & np.uint64((1 << self.low_bits) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = self.lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        ok = inside & (lo < end)
        at = np.where(ok, lo, 0)
        return np.where(ok & (self.lows(at) == want), at, -1)

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.low_bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high}

    @classmethod
    def of(cls, parts: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low_bits = map(int, parts[f"{name}.head"])
        return cls(n, low_bits, parts[f"{name}.low"], parts[f"{name}.high"])


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and a codebook of at most 256 means of equally wide bins; few distinct values stay exact."""
    u, inverse = np.unique(values, return_inverse=True)
    if len(u) <= 256:
        return inverse.astype(np.uint8), u
    code = np.minimum((values - u[0]) * (256 / (u[-1] - u[0])), 255).astype(np.int64)
    n = np.bincount(code, minlength=256)
    book = np.bincount(code, values, minlength=256) / np.maximum(n, 1)
    return code.astype(np.uint8), book


class Trie:
    """Counts of words and, quantised, the log numerators of words after their contexts."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.words, self.pointers, self.contexts = (EliasFano.of(parts, x) for x in ("words", "pointers", "contexts"))
        self.counts, self.codes, self.book = parts["counts"], parts["codes"], parts["book"]

    @classmethod
    def build(cls, w: np.ndarray, h: np.ndarray, c: np.ndarray, total: int, known: int, mu: float = MU, whole: tuple | None = None) -> Trie:
        """From pairs sorted by word, then context, without repeats; whole: see Split.counts."""
        new = np.concatenate([[True], w[1:] != w[:-1]]) if len(w) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(c, starts) if len(starts) else np.zeros(0, np.int64)
        if len(starts) > 1 << (64 - CONTEXT_BITS):
            raise ValueError(f"{len(starts)} words in a shard; use more shuffle partitions")
        if whole is not None:
            counts = _overridden(w[starts], counts, *whole)
        rank = np.cumsum(new) - 1
        value = np.log10(c + mu * (counts[rank] + 1) / (total + known + 1)) if len(w) else np.zeros(0)
        codes, book = quantised(value)
        relative = (rank.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | h
        parts = EliasFano.build(w[starts]).parts("words") | EliasFano.build(np.append(starts, len(w)).astype(np.uint64)).parts("pointers") | EliasFano.build(relative).parts("contexts")
        return cls(parts | {"counts": counts.astype(np.int64), "codes": codes, "book": book})

    def dump(self) -> bytes:
        arrays = self.words.parts("words") | self.pointers.parts("pointers") | self.contexts.parts("contexts") | {"counts": self.counts, "codes": self.codes, "book": self.book}
        head, at = {}, 0
        for k, v in arrays.items():
            head[k] = (v.dtype.str, v.shape, at)
            at += (v.nbytes + 7) // 8 * 8
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        return b"".join([len(text).to_bytes(8, "little"), text, *[np.ascontiguousarray(v).tobytes() + bytes(-v.nbytes % 8) for v in arrays.values()]])

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """Maps the levels from an unlinked file, so that pages come in as they are read."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            raw = np.memmap(f, np.uint8, "r")
        start = 8 + int.from_bytes(raw[:8].tobytes(), "little")
        parts = {}
        for k, (kind, shape, at) in json.loads(raw[8:start].tobytes()).items():
            size = int(np.prod(shape, dtype=np.int64)) * np.dtype(kind).itemsize
            parts[k] = raw[start + at : start + at + size].view(kind).reshape(shape)
        return cls(parts)

    def count(self, w: np.ndarray, whole: tuple | None = None) -> np.ndarray:
        i = self.words.find(w)
        out = np.where(i >= 0, self.counts[np.maximum(i, 0)], 0) if len(self.counts) else np.zeros(len(w), np.int64)
        return out if whole is None else _overridden(w, out, *whole)

    def numerator(self, w: np.ndarray, h: np.ndarray, total: int, known: int, mu: float = MU, whole: tuple | None = None) -> np.ndarray:
        """log10 of c(hw) + mu * (c(w) + 1) / (N + V + 1)."""
        i = self.words.find(w)
        out = np.log10(mu * (self.count(w, whole) + 1) / (total + known + 1))
        at = np.flatnonzero(i >= 0)
        if len(at):
            j = self.contexts.find((i[at].astype(np.uint64) << np.uint64(CONTEXT_BITS)) | h[at])
            begin, end = self.pointers.get(i[at]).astype(np.int64), self.pointers.get(i[at] + 1).astype(np.int64)
            hit = (j >= begin) & (j < end)
            out[at[hit]] = self.book[self.codes[j[hit]]]
        return out


def _overridden(w: np.ndarray, counts: np.ndarray, keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The counts, with those of keys replaced by totals."""
    if not len(keys):
        return counts
    at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
    return np.where(keys[at] == w, totals[at], counts)


class Split:
    """Frequent words that go as several: words (sorted) and their counts in training tokens."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, shards: int):
        often = counts * (SHARE * shards) > total
        order = np.argsort(words[often])
        self.words, counts = words[often][order], counts[often][order]
        self.classes = -(-counts * (SHARE * shards) // max(total, 1))
        keys = np.concatenate([_class_key(np.repeat(self.words, self.classes), np.arange(int(self.classes.sum())) - np.repeat(np.cumsum(self.classes) - self.classes, self.classes))]) if len(counts) else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        #: Keys of all words that these go as, and the whole count of each.
        self.counts = keys[order], np.repeat(counts, self.classes)[order]

    def keys(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The words w in the contexts h as they go."""
        if not len(self.words):
            return w
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == w)
        out = w.copy()
        out[hit] = _class_key(w[hit], (h[hit] % self.classes[at[hit]].astype(np.uint64)).astype(np.int64))
        return out


def _class_key(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    return tx.mixed(w ^ tx.mixed((k + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _end() -> np.uint64:
    return tx.hashed(pa.array([tx.END_WORD]))[0]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and row offsets; each row ends with the end."""
    flat, offsets = tx.words(texts, lower=True)
    codes, distinct = tx.coded(flat)
    out = np.full(len(codes) + len(texts), _end(), np.uint64)
    at = np.arange(len(codes)) + tx.row_of(offsets)
    out[at] = tx.hashed(distinct)[codes]
    return out, offsets + np.arange(len(offsets))


def _shard(w: np.ndarray, shards: int) -> np.ndarray:
    return ((w >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _vocabulary(shards: int):
    """Distinct training words of a block by shard, with their counts."""

    def run(batches):
        for block in tx.blocks(batches):
            w, offsets = tokens(tx.column(block, "text"))
            learn = ~np.asarray(tx.column(block, "held_out").cast(pa.int8())).astype(bool)
            w = w[np.repeat(learn, np.diff(offsets))]
            u, c = np.unique(w, return_counts=True)
            cuts = np.searchsorted(_shard(u, shards), np.arange(shards + 1))
            full = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([u[cuts[s] : cuts[s + 1]].tobytes() for s in full], pa.binary()), pa.array([_small(c[cuts[s] : cuts[s + 1]]) for s in full], pa.binary())], ["shard", "w", "c"])

    return run


def _distinct(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distinct words and tokens of a shard, and its words with a sixteenth of them or more."""
    ws = [np.frombuffer(x, np.uint64) for x in pdf["w"]]
    u, at = np.unique(np.concatenate(ws), return_inverse=True)
    c = np.rint(np.bincount(at, np.concatenate([_counts(x, len(w)) for x, w in zip(pdf["c"], ws)]), minlength=len(u))).astype(np.int64)
    often = c * 16 >= c.sum()
    return pd.DataFrame({"known": [len(u)], "total": [int(c.sum())], "w": [u[often].tobytes()], "c": [c[often].tobytes()]})


_QUERIES = "shard int, block long, w binary, nw binary, h binary, c binary, occ binary, times binary, rows binary"


def _pairs(shards: int, shared):
    """Distinct (word, context) of a block by shard: training counts, and the rows in which they occur."""

    def run(batches):
        block_no = TaskContext.get().partitionId() << 24
        for block in tx.blocks(batches, 8 << 20):
            w, offsets = tokens(tx.column(block, "text"))
            h = np.empty_like(w)
            h[1:] = w[:-1]
            h[offsets[:-1]] = _end()
            h = tx.mixed(h) >> np.uint64(64 - CONTEXT_BITS)
            w = shared.value.keys(w, h)
            row = tx.row_of(offsets)
            order = np.lexsort((h, w))
            w, h, row = w[order], h[order], row[order].astype(np.uint16)
            new = np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])])
            starts = np.flatnonzero(new)
            learn = ~np.asarray(tx.column(block, "held_out").cast(pa.int8())).astype(bool)
            c = np.add.reduceat(learn[row].astype(np.int64), starts)
            occ = np.diff(np.append(starts, len(w)))
            w, h = w[starts], h[starts]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            nw = np.diff(np.append(first, len(w)))
            cuts = np.searchsorted(_shard(w, shards), np.arange(shards + 1))
            fcuts = np.searchsorted(first, cuts)
            ends = np.append(starts, len(row))[cuts]
            names = [tx.column(block, x) for x in ("rid", "doc_id", "held_out")]
            heads = np.column_stack([np.asarray(names[0]).astype(np.int64), np.asarray(names[1].fill_null(0)), np.asarray(names[1].is_valid().cast(pa.int8())), np.asarray(names[2].cast(pa.int8()))]).astype(np.int64).tobytes()
            data = []
            keep_heads = block_no % shards
            for s in range(shards):
                a, b = cuts[s], cuts[s + 1]
                if a == b and s != keep_heads:
                    continue
                f = slice(fcuts[s], fcuts[s + 1])
                hh = h[a:b]
                data.append((s, block_no, w[first[f]].tobytes(), nw[f].astype(np.uint32).tobytes(), np.ascontiguousarray(hh.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes(), _small(c[a:b]), _small(occ[a:b]), heads if s == keep_heads else None, row[ends[s] : ends[s + 1]].tobytes()))
            block_no += 1
            cols = list(zip(*data))
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], [x.split()[0] for x in _QUERIES.split(", ")])

    return run


def _small(n: np.ndarray) -> bytes:
    """Counts in a byte each, larger ones listed after."""
    big = np.flatnonzero(n > 254)
    out = n.astype(np.uint8)
    out[big] = 255
    return out.tobytes() + n[big].astype(np.uint32).tobytes()


def _counts(b: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(b, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(b, np.uint32, offset=n)
    return out


def _unpack(w: bytes, nw: bytes, h: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, contexts and the place of each pair's word."""
    words, sizes = np.frombuffer(w, np.uint64), np.frombuffer(nw, np.uint32)
    raw = np.zeros((len(h) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(h, np.uint8).reshape(-1, 5)
    return words, raw.view(np.uint64).ravel(), np.repeat(np.arange(len(words)), sizes)


def _learn_and_score(total: int, known: int, mu: float, shared):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = shared.value.counts
        ws, hs, cs = [], [], []
        for w, nw, h, c in zip(pdf["w"], pdf["nw"], pdf["h"], pdf["c"]):
            words, ctx, at = _unpack(w, nw, h)
            c = _counts(c, len(ctx))
            seen = c > 0
            ws.append(words[at[seen]])
            hs.append(ctx[seen])
            cs.append(c[seen])
        w, h, c = np.concatenate(ws), np.concatenate(hs), np.concatenate(cs)
        del ws, hs, cs
        order = np.lexsort((h, w))
        w, h, c = w[order], h[order], c[order]
        if len(w):
            starts = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])]))
            w, h, c = w[starts], h[starts], np.add.reduceat(c, starts)
        trie = Trie.mapped(Trie.build(w, h, c, total, known, mu, whole).dump())
        del w, h, c, order
        out = []
        for block, w, nw, h, occ, rows, heads in zip(pdf["block"], pdf["w"], pdf["nw"], pdf["h"], pdf["occ"], pdf["rows"], pdf["times"]):
            words, ctx, at = _unpack(w, nw, h)
            times = _counts(occ, len(ctx))
            row = np.frombuffer(rows, np.uint16).astype(np.int64)
            n = int(row.max()) + 1 if len(row) else 0
            count = trie.count(words, whole)
            per_pair = trie.numerator(words[at], ctx, total, known, mu, whole) - np.log10(count + mu)[at]
            sums = np.zeros((4, n))
            for i, v in enumerate((np.ones(len(at)), (count > 0)[at].astype(float), np.log10(count + 1)[at], per_pair)):
                sums[i] = np.bincount(row, np.repeat(v, times), minlength=n)
            out.append((block, sums.tobytes(), heads))
        return pd.DataFrame(out, columns=["block", "sums", "heads"])

    return run


def _add_up(total: int, known: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = np.frombuffer(pdf.loc[pdf["heads"].notna(), "heads"].iloc[0], np.int64).reshape(-1, 4)
        sums = np.zeros((4, len(heads)))
        for x in pdf.sort_values("shard")["sums"]:
            part = np.frombuffer(x, np.float64).reshape(4, -1)
            sums[:, : part.shape[1]] += part
        n = np.rint(sums[0]).astype(np.int64)
        ids = pd.array(heads[:, 1], dtype="Int64")
        ids[heads[:, 2] == 0] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": heads[:, 3] == 1, "n_tokens": n, "n_known": np.rint(sums[1]).astype(np.int64), "train_tokens": total, "base_score": sums[2] - n * np.log10(total + known + 1), "score": sums[3]})

    return run


def score(docs: DataFrame, folds: int = FOLDS, held: int = HELD, mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    shards = min(tx.shuffle_width(spark), 1 << 15)
    fold = F.crc32(F.col("doc_id").cast("string")) % folds == held
    rows = tx.documents(docs)
    rows = rows.select("doc_id", "text", F.coalesce(fold, F.lit(False)).alias("held_out"), tx.row_key(rows).alias("rid"))
    vocabulary = rows.select("text", "held_out").mapInArrow(_vocabulary(shards), "shard int, w binary, c binary")
    # a row for each shard, with 16 words at most
    sizes = vocabulary.groupBy("shard").applyInPandas(_distinct, "known long, total long, w binary, c binary").collect()
    known, total = sum(r.known for r in sizes), sum(r.total for r in sizes)
    frequent = (np.frombuffer(b"".join(r[k] for r in sizes), t) for k, t in (("w", np.uint64), ("c", np.int64)))
    shared = spark.sparkContext.broadcast(Split(*frequent, total, shards))
    pairs = rows.mapInArrow(_pairs(shards, shared), _QUERIES)
    learn = _learn_and_score(total, known, mu, shared)

    def by_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        return learn(pdf).assign(shard=pdf["shard"].iloc[0])

    sums = pairs.groupBy("shard").applyInPandas(by_shard, "block long, sums binary, heads binary, shard int")
    return sums.groupBy("block").applyInPandas(_add_up(total, known), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
