"""Merkle manifest of a table: a hash tree for each source, and one over the sources' roots.

Leaves get their place in a tree from one exchange by ranges, and each aligned run of
`FANOUT` ** 2 leaves becomes a block that hashes its own two levels. Blocks then learn
what is above them by a butterfly exchange: in round r the blocks of up to `FANOUT`
neighbouring subtrees of FANOUT ** r blocks each meet in groups, one block of every
subtree to a group, swap their subtrees' roots, and each hashes the common ancestor for
itself. After the last round every block has all upper siblings, with one exchange a
round and no pass downward. The last subtree of a tree may be short of blocks; those it
has then stand in for the missing ones. No group has more than FANOUT rows, so a source
with a third of all rows is spread like any other. The roots of the sources are leaves
of a further tree, made in the same way.

A leaf is the hash of doc_id, source, lang, n_chars and text (missing columns count as
null); further columns are not read. Leaves of a source go by doc_id, nulls first, then
by hash, so repeated rows are neighbours; each keeps its row. A null source is a tree of
its own, before all others. Texts are hashed whole, in the scan, and don't move. An
empty table has no rows and no root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import text as tx

FANOUT = 16
BLOCK = FANOUT**2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<digit: int, nodes: array<string>>>"


def combined(nodes: Column) -> Column:
    """The parent of nodes: the hash of their digests, in order."""
    return F.sha2(F.array_join(nodes, ""), 256)


def field(c: Column) -> Column:
    """A value as its byte count, a colon and itself; `-` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, start, lambda acc, p: F.sha2(F.concat(F.array_join(F.slice(p["nodes"], 1, p["digit"]), ""), acc, F.array_join(F.slice(p["nodes"], p["digit"] + 2, FANOUT), "")), 256))


def siblings(path: Column) -> Column:
    """The other nodes of each run of a path, level by level, left to right."""
    return F.flatten(F.transform(path, lambda p: F.concat(F.slice(p["nodes"], 1, p["digit"]), F.slice(p["nodes"], p["digit"] + 2, FANOUT))))


def _numbered(batches):
    """Rows in order with part, local (place in the run of their tree in this partition) and head (of the partition's first run)."""
    part, last, n, head = TaskContext.get().partitionId(), None, 0, True
    for b in batches:
        rows = b.num_rows
        if not rows:
            continue
        tree, at = b.column("tree"), np.arange(rows)
        new = np.ones(rows, bool)
        new[1:] = np.asarray(pc.not_equal(tree[1:], tree[:-1]))
        new[0] = tree[0].as_py() != last
        begun = np.maximum.accumulate(np.where(new, at, -n))
        heads = np.cumsum(new) == (last is None) if head else np.zeros(rows, bool)
        local = at - begun
        last, n, head = tree[-1].as_py(), int(local[-1]) + 1, bool(heads[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(rows, part), pa.int64()), pa.array(local, pa.int64()), pa.array(heads)], [*b.schema.names, "part", "local", "head"])


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree not null, ...) with pos, the place of each in its tree: one exchange by ranges, then what came before each partition."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in leaves.dtypes)
    # rows that agree in all of order may be dealt apart: the last key tells them from each other
    dealt = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_tie").sortWithinPartitions("tree", *order)
    rows = tx.checkpoint(dealt.drop("_tie").mapInArrow(_numbered, kinds + ", part long, local long, head boolean"))
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("n"), F.max("head").alias("head"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", before).where(F.col("head")).select("part", F.lit(True).alias("head"), F.coalesce("before", F.lit(0)).alias("before"))
    # one number for each partition, whatever the rows
    return rows.join(F.broadcast(offsets), ["part", "head"], "left").withColumn("pos", F.col("local") + F.coalesce("before", F.lit(0))).drop("part", "local", "head", "before")


def blocks(leaves: DataFrame, keep: list[str]) -> DataFrame:
    """tree, block, rows (kept columns), runs (leaves by FANOUT), level (their parents) and node (the block's root)."""
    found = leaves.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "leaf", *keep))).alias("rows"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / FANOUT).cast("int")), lambda c: F.transform(F.slice(F.col("rows"), c * FANOUT + 1, FANOUT), lambda r: r["leaf"]))
    found = found.withColumn("runs", runs).withColumn("level", F.transform("runs", combined))
    # a block that is its whole tree ends as soon as one node is left
    node = F.when((F.col("block") == 0) & (F.size("rows") == 1), F.col("runs")[0][0]).when((F.col("block") == 0) & (F.size("runs") == 1), F.col("level")[0]).otherwise(combined(F.col("level")))
    return tx.checkpoint(found.withColumn("node", node))


def butterfly(nodes: DataFrame) -> DataFrame:
    """tree, block, root and path (FANOUT-wide runs from the block up) of nodes (tree, block, node) that fill 0, 1, ... of each tree."""
    sizes = nodes.groupBy("tree").agg((F.max("block") + 1).alias("size"))
    state = tx.checkpoint(nodes.select("tree", "block", "node").join(sizes, "tree").withColumn("path", F.array().cast(PATH)))
    most, span = state.agg(F.max("size")).first()[0] or 1, 1
    while span < most:
        digit, low, on = (F.floor(F.col("block") / span) % FANOUT).cast("int"), F.col("block") % span, F.col("size") > span
        have = F.least(F.lit(span), F.col("size") - (F.col("block") - low))  # blocks of the own subtree
        slots = F.sequence(low, F.when(on & (digit > 0), F.lit(span - 1)).otherwise(low), have)
        sent = state.select("tree", "block", "node", "size", F.when(on, digit).alias("digit"), F.floor(F.col("block") / (span * FANOUT)).alias("group"), low.alias("low"), "path", F.explode(slots).alias("slot"))
        sent = sent.withColumn("path", F.when(F.col("slot") == F.col("low"), F.col("path")))
        met = F.transform(F.array_sort(F.collect_list(F.struct("digit", "node")).over(Window.partitionBy("tree", "group", "slot"))), lambda x: x["node"])
        own = sent.withColumn("nodes", met).where("slot = low")
        more = F.concat("path", F.array(F.struct("digit", "nodes")).cast(PATH))
        state = own.select("tree", "block", "size", F.when(on, combined(F.col("nodes"))).otherwise(F.col("node")).alias("node"), F.when(on, more).otherwise(F.col("path")).alias("path"))
        span *= FANOUT
    return state.select("tree", "block", F.col("node").alias("root"), "path")


def paths(found: DataFrame, keep: list[str], upper: DataFrame, more: list[str]) -> DataFrame:
    """A row for each leaf: kept columns, leaf, path up to the top, and more columns of upper (tree, block, path, ...)."""
    one = F.col("block").isin(0)

    def row(r, i):
        run = F.floor(i / FANOUT).cast("int")
        first = F.struct((i % FANOUT).cast("int").alias("digit"), F.element_at("runs", run + 1).alias("nodes"))
        second = F.struct(run.alias("digit"), F.col("level").alias("nodes"))
        own = F.when(one & (F.size("rows") == 1), F.array().cast(PATH)).when(one & (F.size("runs") == 1), F.array(first).cast(PATH)).otherwise(F.array(first, second).cast(PATH))
        return F.struct(*[r[c].alias(c) for c in keep], r["leaf"].alias("leaf"), F.concat(own, F.col("path")).alias("path"))

    each = found.join(upper, ["tree", "block"]).select("tree", *more, F.explode(F.transform("rows", row)).alias("r"))
    return each.select("tree", *more, "r.*")


def prove(leaves: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """tree, kept columns, leaf, subroot, root and path of every row of leaves (tree, leaf, ...)."""
    found = blocks(placed(leaves, order), keep)
    own = tx.checkpoint(butterfly(found))
    roots = own.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("leaf"))
    above = blocks(placed(roots, ["source"]), ["source"])
    top = paths(above, ["source"], butterfly(above), ["root"]).select(F.col("source").alias("tree"), "root", F.col("path").alias("top"))
    upper = own.withColumnRenamed("root", "subroot").join(top, "tree").select("tree", "block", "subroot", "root", F.concat("path", "top").alias("path"))
    return paths(found, keep, upper, ["subroot", "root"])


def manifest(docs: DataFrame, further: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, tree (`s` and the source; empty for null), leaf, subroot, root, path, and further columns of every row of docs."""
    have = {c.lower() for c in docs.columns}
    docs = docs.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in FIELDS])
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select("doc_id", tree.alias("tree"), leaf([F.col(c) for c in FIELDS]).alias("leaf"), *[v.alias(k) for k, v in (further or {}).items()])
    return prove(leaves, ["doc_id", "leaf"], ["doc_id", *(further or {})])


def digests(docs: DataFrame, share: int = 5) -> DataFrame:
    """Leaf, roots and proof digest of every row, and the root recomputed where rows picked by their id's CRC-32 were tampered with."""
    altered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % share == 0, leaf(altered))
    rows = manifest(docs, {"tampered": tampered}).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", combined(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
