"""Column-wise helpers on blocks of text, shared by the operators of this package.

A block is a slice of an Arrow batch that holds a bounded number of bytes, so
memory per task does not follow the size of a partition. Words are maximal runs
of characters other than space and \\x09-\\x0D.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 12 << 20
END_WORD = "\n"  # cannot occur as a word


def row_key(df: DataFrame) -> Column:
    """A non-null key of (doc_id, text): rows that repeat share it and get the same result."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def raw_key() -> Column:
    """row_key of rows that are not yet brought to doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def private(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text (null: empty) with any further columns, and nothing else."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only in a session without executors elsewhere, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark deletes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir, so that lost executors lose nothing.

    The shuffle files that led to it are of no more use and go at once.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)


def blocks(batches: Iterable[pa.RecordBatch], max_bytes: int = BLOCK_BYTES, column: str = "text", max_rows: int = 60_000) -> Iterator[pa.Table]:
    """Regroup record batches into blocks of about max_bytes of text (a longer text is a block of its own)."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            ends = np.cumsum(lengths[start:])
            n = int(min(np.searchsorted(ends, max_bytes - size, side="right"), max_rows - rows))
            if n == 0 and not held:
                n = 1
            if n:
                held.append(batch.slice(start, n))
                size += int(ends[n - 1])
                rows += n
                start += n
            if start < batch.num_rows or size >= max_bytes or rows >= max_rows:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and offsets: row i has words[offsets[i]:offsets[i + 1]]."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = np.asarray(split.offsets).astype(np.int64)
    flat = split.flatten()
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return flat, offsets


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the block's distinct words."""
    d = flat.dictionary_encode()
    return np.asarray(d.indices).astype(np.int64), d.dictionary


def hashed(values: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct strings."""
    if not len(values):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(values.to_pylist(), dtype=object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def windows_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive 64-bit values; runs may cross rows, callers mask those."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : i + m]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mixed(h)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
