"""N-gram Jaccard join: groups of texts linked by the overlap of their word shingles.

The incidence matrix of texts by shingles is cut into blocks of texts by ranges of
shingle hashes. A first product, with a vector of ones, counts in each range how
many of a text's shingles occur elsewhere. A link needs an overlap of at least
`percent` of the larger set, so a text with fewer shared shingles can link with
nothing and leaves exactly. Texts with equal sets are one class with one
representative. The remaining representatives are grouped by shared shingles of
their prefixes (the size-derived bound, common shingles last), and within a group
blocks of the matrix are multiplied range by range: overlaps add up, pairs below
the bound are discarded, and each block sends on the links that span its parts.
Large groups first link to a few pivots. Across the parts that remain, texts that meet
in a short list of a shared prefix shingle are compared by the pair, each once; only
those in long lists are multiplied in blocks. So a group of near copies, or a chain of
texts of which each shares shingles with the next, costs in proportion to its size.

Null and empty texts have an empty set and link with nothing; texts with fewer
words than a shingle have their whole sequence as one. Repeated rows have equal
sets. Null doc_ids take part but never name a component (one of only such rows has
a null component). Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import graph
from tidemark.llm import text as tx

WORDS = 5
PERCENT = 80
HOT = 64  # shingles in more rows than this are ordered by how common they are
BLOCK = 256  # texts on a side of a block of the product
PIVOTS = 4
SHORT = 64  # lists of a shingle with up to so many texts are compared by the pair
RANGE_BITS = 38
NO_ID = np.iinfo(np.int64).max


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, row) of each text's n-word shingles, by hash, then row."""
    flat, offsets = tx.words(texts, lower=True)
    codes, distinct = tx.coded(flat)
    h = tx.hashed(distinct)[codes]
    row = tx.row_of(offsets)
    keys = tx.windows_hash(h, n)
    inside = row[: len(keys)] == row[len(row) - len(keys) :]
    keys, rows = keys[inside], row[: len(keys)][inside]
    count = np.diff(offsets)
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            at = offsets[:-1][short]
            own = np.full(len(short), np.uint64(k))
            for i in range(k):
                own = tx.mixed(own * np.uint64(31) ^ h[at + i])
            keys, rows = np.concatenate([keys, own]), np.concatenate([rows, short])
    if count.size and (count < n).any():
        order = np.lexsort((rows, keys))
    else:
        order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[new], rows[new]


def set_prints(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and fingerprint of each row's set."""
    m = tx.mixed(keys ^ np.uint64(0x5851F42D4C957F2D))
    low = np.bincount(rows, (m & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n).astype(np.uint64)
    high = np.bincount(rows, (m >> np.uint64(32)).astype(np.float64), minlength=n).astype(np.uint64)
    sizes = np.bincount(rows, minlength=n)
    return sizes, tx.mixed(tx.mixed(low) + high * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64)).view(np.int64)


def range_bounds(parts: int) -> np.ndarray:
    """Where the ranges begin and end in the upper 32 bits of the hashes."""
    return (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts)


def low_bits(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(64 - RANGE_BITS)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def planes(x: np.ndarray) -> bytes:
    """Bytes of sorted integers, plane by plane, which the shuffle's compression shortens."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


_PACKED = "block long, part int, h binary, d binary, rids binary, ids binary, sizes binary, prints binary"


def _pack(parts: int, n_words: int):
    def run(batches):
        block_no = TaskContext.get().partitionId() << 24
        for block in tx.blocks(batches):
            keys, rows = shingles(tx.column(block, "text"), n_words)
            sizes, prints = set_prints(keys, rows, block.num_rows)
            ids = np.asarray(tx.column(block, "doc_id").fill_null(int(NO_ID))).astype(np.int64)
            rids = np.asarray(tx.column(block, "rid")).astype(np.int64)
            cuts = np.searchsorted(keys >> np.uint64(32), range_bounds(parts))
            low = low_bits(keys)
            data = {k: [] for k in ("block", "part", "h", "d", "rids", "ids", "sizes", "prints")}
            for p in range(parts):
                s, e = cuts[p], cuts[p + 1]
                first = p == block_no % parts
                if s == e and not first:
                    continue
                for k, v in (("block", block_no), ("part", p), ("h", planes(low[s:e])), ("d", rows[s:e].astype(np.uint16).tobytes()), ("rids", rids.tobytes() if first else None), ("ids", ids.tobytes() if first else None), ("sizes", sizes.astype(np.int64).tobytes() if first else None), ("prints", prints.tobytes() if first else None)):
                    data[k].append(v)
            block_no += 1
            yield pa.RecordBatch.from_arrays([pa.array(data["block"], pa.int64()), pa.array(data["part"], pa.int32()), *[pa.array(data[k], pa.binary()) for k in ("h", "d", "rids", "ids", "sizes", "prints")]], list(data))

    return run


def _count_shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one range: how many shingles of each row occur in other rows, and which of them are common."""
    hs = [from_planes(x, np.uint32) for x in pdf["h"]]
    h = np.concatenate(hs)
    order = np.argsort(h, kind="stable")
    s = h[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
    n = np.diff(np.append(starts, len(s)))
    df = np.empty(len(h), np.int64)
    df[order] = np.repeat(n, n)
    counts, hot_row, hot_key, at, part = [], [], [], 0, np.uint64(pdf["part"].iloc[0])
    for x, d in zip(hs, pdf["d"]):
        d, own = np.frombuffer(d, np.uint16), df[at : at + len(x)]
        counts.append(np.bincount(d[own > 1], minlength=1).astype(np.uint32).tobytes())
        hot = own > HOT
        level = np.log2(own[hot]).astype(np.uint64)
        hot_row.append(d[hot].tobytes())
        hot_key.append((x[hot].astype(np.uint64) | (part << np.uint64(32)) | (level << np.uint64(48))).tobytes())
        at += len(x)
    out = pdf[["block", "part", "rids", "ids", "sizes", "prints"]].copy()
    out["counts"], out["hot_row"], out["hot_key"] = counts, hot_row, hot_key
    return out


_COUNTED = "block long, part int, rids binary, ids binary, sizes binary, prints binary, counts binary, hot_row binary, hot_key binary"


def _sum_block(pdf: pd.DataFrame) -> pd.DataFrame:
    own = pdf[pdf["rids"].notna()].iloc[0]
    rids, ids, sizes, prints = (np.frombuffer(own[c], np.int64) for c in ("rids", "ids", "sizes", "prints"))
    shared = np.zeros(len(rids), np.int64)
    hot_row, hot_key = [], []
    for part, c, r, k in zip(pdf["part"], pdf["counts"], pdf["hot_row"], pdf["hot_key"]):
        c = np.frombuffer(c, np.uint32)
        shared[: len(c)] += c
        hot_row.append(np.frombuffer(r, np.uint16))
        hot_key.append(np.frombuffer(k, np.uint64))
    hot_row, hot_key = np.concatenate(hot_row), np.concatenate(hot_key)
    order = np.argsort(hot_row, kind="stable")
    cuts = np.searchsorted(hot_row[order], np.arange(len(rids) + 1))
    hot_key = hot_key[order]
    keep = shared * 100 >= PERCENT * sizes
    hot = [hot_key[s:e].tobytes() if k and e > s else None for s, e, k in zip(cuts[:-1], cuts[1:], keep)]
    return pd.DataFrame({"rid": rids, "doc_id": ids, "n": sizes, "node": prints, "shared": shared, "hot": hot})


def _ranges(docs: DataFrame) -> int:
    return min(tx.shuffle_width(docs.sparkSession), 1 << 16)


def incidence_counts(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """rid, doc_id, n (set size), node (fingerprint of the set), shared and the common shingles of every row."""
    docs = tx.documents(docs)
    parts = _ranges(docs)
    packed = docs.withColumn("rid", tx.row_key(docs)).mapInArrow(_pack(parts, n_words), _PACKED)
    counted = packed.groupBy("part").applyInPandas(_count_shared, _COUNTED)
    return counted.groupBy("block").applyInPandas(_sum_block, "rid long, doc_id long, n long, node long, shared long, hot binary")


def prefix(keys: np.ndarray, hot: bytes | None, parts: int) -> np.ndarray:
    """The shingles of a set of which a linked set must share one: rare ones first.

    hot: range and low bits of the common ones, by which they were counted, and above
    them the logarithm of the count; so all sets order their shingles alike.
    """
    n = len(keys)
    p = n - (n * PERCENT + 99) // 100 + 1
    if hot:
        k = np.frombuffer(hot, np.uint64)
        common = k & np.uint64((1 << 48) - 1)
        order = np.argsort(common)
        common, level = common[order], (k >> np.uint64(48))[order]
        part = (np.searchsorted(range_bounds(parts), keys >> np.uint64(32), side="right") - 1).astype(np.uint64)
        own = low_bits(keys) | (part << np.uint64(32))
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        grade = np.where(common[at] == own, level[at], 0)
        keys = keys[np.lexsort((keys, grade))]
    return keys[:p]


def _sets(n_words: int, parts: int):
    def run(frames):
        for pdf in frames:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                keys, rows = shingles(pa.array(part["text"], pa.string()), n_words)
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(len(part) + 1))
                own = [keys[order[s:e]] for s, e in zip(cuts[:-1], cuts[1:])]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "n": part["n"].to_numpy(), "keys": [x.tobytes() for x in own], "prefix": [prefix(x, h, parts).view(np.int64) for x, h in zip(own, part["hot"])]})

    return run


def linked(a: np.ndarray, b: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    return overlap * (100 + PERCENT) >= PERCENT * (a[:, None] + b[None, :])


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Overlap counts of two lists of sets: dense products of slices of the shared columns, added up."""
    flat = np.concatenate(xs + ys)
    side = np.repeat(np.arange(len(xs) + len(ys)), [len(v) for v in xs + ys])
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    useful = n[col] > 1
    _, col = np.unique(col[useful], return_inverse=True)
    side = side[useful]
    total = np.zeros((len(xs), len(ys)))
    order = np.argsort(col, kind="stable")
    col, side = col[order], side[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        s, e = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(xs) + len(ys), width), np.float32)
        m[side[s:e], col[s:e] - lo] = 1
        total += m[: len(xs)] @ m[len(xs) :].T
    return np.rint(total).astype(np.int64)


def _spanning(nodes: np.ndarray, link: np.ndarray) -> list[tuple[int, int]]:
    """Links from each node to the least-placed node of its part."""
    label = np.arange(len(nodes))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(nodes)).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(nodes[i]), int(nodes[k])) for i, k in enumerate(label) if i != k]


def _multiply(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of small groups, and of pairs of blocks of large ones, that came to one task together."""
    out: list[tuple[int, int]] = []
    for _, g in pdf.groupby(["grp", "i", "j"], sort=False):
        if len(g) < 2:
            continue
        g = g.drop_duplicates("node")
        sets = [np.frombuffer(x, np.uint64) for x in g["keys"]]
        nodes, sizes = g["node"].to_numpy(), g["n"].to_numpy()
        link = linked(sizes, sizes, overlaps(sets, sets))
        out += _spanning(nodes, link | link.T)
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _to_pivots(frames):
    for pdf in frames:
        rows = []
        for node, n, keys, pivots in zip(pdf["node"], pdf["n"], pdf["keys"], pdf["pivots"]):
            own = np.frombuffer(keys, np.uint64)
            for p in pivots:
                other = np.frombuffer(p["keys"], np.uint64)
                o = len(np.intersect1d(own, other, assume_unique=True))
                if p["node"] != node and o * (100 + PERCENT) >= PERCENT * (len(own) + len(other)):
                    rows.append((node, p["node"]))
                    break
        yield pd.DataFrame(rows, columns=["a", "b"]).astype("int64")


def _verified(frames):
    for pdf in frames:
        hit = []
        for x, y in zip(pdf["x"], pdf["y"]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            hit.append(len(np.intersect1d(x, y, assume_unique=True)) * (100 + PERCENT) >= PERCENT * (len(x) + len(y)))
        yield pdf.loc[np.array(hit, bool), ["a", "b"]]


def _short_links(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Links between texts of different parts that a list brings together. entries: h, node, n, at (place in the prefix), lab."""
    x, y = (entries.select("h", *[F.col(c).alias(f"{c}{k}") for c in ("node", "n", "at", "lab")]) for k in "12")
    both = x.join(y, "h").where("node1 < node2 and lab1 != lab2")
    # sizes, and what can still follow the place of the shingle, must allow the overlap
    rest = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    able = both.where((F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * PERCENT) & (rest * (100 + PERCENT) >= PERCENT * (F.col("n1") + F.col("n2"))))
    pairs = able.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()
    sides = pairs.join(keys.select(F.col("node").alias("a"), F.col("keys").alias("x")), "a").join(keys.select(F.col("node").alias("b"), F.col("keys").alias("y")), "b")
    return sides.select("a", "b", "x", "y").mapInPandas(_verified, "a long, b long")


def _large_links(members: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Links inside groups of more than BLOCK texts. members: grp, node, n, keys; prefixes: node, prefix."""
    pivots = members.groupBy("grp").agg(F.min_by(F.struct("node", "keys"), F.struct(F.xxhash64("node"), "node")).alias("p0"), *[F.min_by(F.struct("node", "keys"), F.struct(F.xxhash64("node", F.lit(i)), "node")).alias(f"p{i}") for i in range(1, PIVOTS)])
    pivots = tx.checkpoint(pivots.select("grp", F.array(*[f"p{i}" for i in range(PIVOTS)]).alias("pivots")))
    near = tx.checkpoint(members.join(pivots, "grp").select("node", "n", "keys", "pivots").mapInPandas(_to_pivots, "a long, b long"))
    label = graph.components(near)
    entries = members.select("node", "n").join(prefixes, "node").join(label, "node", "left").select("node", "n", F.coalesce("component", "node").alias("lab"), F.posexplode("prefix").alias("at", "h"))
    lists = entries.groupBy("h").agg(F.count("*").alias("c"), F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo != hi").select("h", "c")
    entries = tx.checkpoint(entries.join(lists, "h"))
    short = tx.checkpoint(_short_links(entries.where(F.col("c") <= SHORT), members))
    long = entries.where(F.col("c") > SHORT).select("node").distinct()
    members = tx.checkpoint(members.join(long, "node"))
    marked = members.select("grp", "node", "n").join(label, "node", "left")
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT))).cast("int")
    marked = marked.withColumn("sc", size_class)
    big = marked.where("component is not null").groupBy("grp", "component").agg(F.count("*").alias("c")).where(F.col("c") >= BLOCK // 2).select("grp", "component", F.lit(True).alias("is_big"))
    marked = marked.join(big, ["grp", "component"], "left").withColumn("lab", F.when(F.col("is_big"), F.col("component"))).drop("is_big", "component")
    cells = marked.groupBy("grp", "lab", "sc").agg(F.count("*").alias("c")).withColumn("subs", F.ceil(F.col("c") / BLOCK).cast("int"))
    cells = tx.checkpoint(cells.withColumn("cell", F.xxhash64("grp", "lab", "sc")))
    parts = cells.select("grp", "lab", "sc", "cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    parts = parts.withColumn("block", F.xxhash64("cell", "sub"))
    left, right = parts.select("grp", *[F.col(c).alias(c + "1") for c in ("lab", "sc", "block")]), parts.select("grp", *[F.col(c).alias(c + "2") for c in ("lab", "sc", "block")])
    pairs = left.join(right, "grp").where("block1 <= block2 and abs(sc1 - sc2) <= 1 and not (lab1 is not null and lab1 <=> lab2)").select("grp", F.col("block1").alias("i"), F.col("block2").alias("j"))
    pairs = tx.checkpoint(pairs)
    sides = pairs.select(F.col("i").alias("block"), "i", "j").unionByName(pairs.where("i != j").select(F.col("j").alias("block"), "i", "j"))
    placed = marked.join(cells.select("grp", "lab", "sc", "cell", "subs"), (marked["grp"] == cells["grp"]) & marked["lab"].eqNullSafe(cells["lab"]) & (marked["sc"] == cells["sc"])).select(marked["grp"], "node", F.xxhash64("cell", F.pmod(F.xxhash64("node"), "subs").cast("int")).alias("block"))
    work = placed.join(sides, "block").join(members.select("node", "n", "keys"), "node").select("grp", "i", "j", "node", "n", "keys")
    links = work.groupBy("i", "j").applyInPandas(_multiply, "a long, b long")
    return near.unionByName(short).unionByName(links)


def classes(docs: DataFrame, n_words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, n, node) of every row, and (node, component) of the linked sets."""
    rows = tx.checkpoint(incidence_counts(docs, n_words))
    kept = rows.where((F.col("n") > 0) & (F.col("shared") * 100 >= PERCENT * F.col("n")))
    reps = kept.groupBy("node").agg(F.min_by(F.struct("rid", "n", "hot"), F.struct("doc_id", "rid")).alias("r")).select("node", "r.rid", "r.n", "r.hot")
    own = tx.documents(docs)
    own = own.withColumn("rid", tx.row_key(own)).select("rid", "text")
    sets = reps.join(own, "rid").dropDuplicates(["rid"]).select("node", "n", "hot", "text").mapInPandas(_sets(n_words, _ranges(docs)), "node long, n long, keys binary, prefix array<long>")
    sets = tx.checkpoint(sets)
    entries = sets.select("node", F.explode("prefix").alias("h"))
    least = entries.groupBy("h").agg(F.min("node").alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = tx.checkpoint(graph.components(entries.join(least, "h").select("node", "m").distinct(), "node", "m").withColumnRenamed("component", "grp"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("g"))
    members = groups.join(sizes, "grp").join(sets.select("node", "n", "keys"), "node")
    small = members.where(F.col("g") <= BLOCK).withColumn("task", F.pmod(F.xxhash64("grp"), F.lit(64 * tx.shuffle_width(docs.sparkSession))))
    links = small.select("task", "grp", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "node", "n", "keys").groupBy("task").applyInPandas(lambda pdf: _multiply(pdf.drop(columns="task")), "a long, b long")
    if sizes.where(F.col("g") > BLOCK).take(1):
        links = links.unionByName(_large_links(tx.checkpoint(members.where(F.col("g") > BLOCK).drop("g")), sets.select("node", "prefix")))
    return rows.select("rid", "doc_id", "n", "node"), graph.components(links)


def join(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """doc_id, rid, n_shingles and component_id (smallest doc_id that links reach) of every row."""
    rows, parts = classes(docs, n_words)
    full = rows.where("n > 0")
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("m")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = nodes.groupBy("component").agg(F.min("m").alias("component_id"))
    named = nodes.select("node", "component").join(named, "component").select("node", "component_id")
    out = full.join(named, "node").select("doc_id", "rid", "n", "component_id").unionByName(rows.where("n = 0").select("doc_id", "rid", "n", F.col("doc_id").alias("component_id")))
    no = F.lit(int(NO_ID))
    return out.select(F.nullif("doc_id", no).alias("doc_id"), "rid", F.col("n").alias("n_shingles"), F.nullif("component_id", no).alias("component_id"))


def keep_one(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """One row of docs for each group: that of the smallest doc_id (nulls last), then of the smallest row key."""
    key = tx.private(docs, "row_key")
    rows, parts = classes(docs, n_words)
    first = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "rid")).alias("f")).join(parts, "node", "left")
    first = first.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("f").alias("f")).select(F.col("f.rid").alias(key))
    ids = first.unionByName(rows.where("n = 0").select(F.col("rid").alias(key))).distinct()
    return docs.withColumn(key, tx.raw_key()).join(ids, key, "left_semi").dropDuplicates([key]).drop(key)
