"""Whitening components of embeddings by shifted Cholesky QR.

Rows become integers, floor(1024 c) + 100,000, and are centred as (n x - S) / n: the
difference is exact, so only one rounding precedes every product. A pass over the rows
brings their Gram matrix, after a triangular solve against the factor found so far; its
Cholesky factor is composed with that one, and the passes end once the rows' Gram matrix
is the identity. The first factor is of a shifted matrix, so that nearly dependent rows
can't break it off. The singular values and vectors of the composed factor are those of
the rows: squared over n they are the covariance's eigenvalues, without the loss of
digits that comes with forming it. Directions without any spread never become
orthonormal; the last Gram matrix's root stands for them in the decomposition, they
have no eigenvalue above rounding, and are left out.

Tasks send one matrix of dims x dims each, summed by Spark row by row; the driver holds
matrices of that size only (dims up to `MOST_DIMS`), which are also what tasks receive.

Rows go whose vector is null or holds a null or non-finite entry, or one beyond what
fits a double exactly as an integer (`LARGEST`). Vectors need one length: where there
are several, the most frequent stays (of equals the longest). Repeated rows count as
often as they occur, null ids too. With fewer dimensions with spread than asked for,
there are fewer components; an empty table, one row, or equal rows give none. Only
vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
PASSES = 8
MOST_DIMS = 2048
LARGEST = 2.0**40
BLOCK_CELLS = 1 << 20
EPS = float(np.finfo(float).eps) / 2


def vectors(table: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and v of the rows that take part, and their length (0 without any row)."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & sound & (F.size("v") > 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims = sizes.d if sizes else 0
    return rows.where(F.size("v") == dims), dims


def integers(flat: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * flat).astype(np.int64) + OFFSET


def _matrices(batches, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with a bounded number of cells, and their integers."""
    step = max(1, BLOCK_CELLS // dims)
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part, integers(np.asarray(part.column("v").flatten()).reshape(-1, dims))


def _summed(name: str, dims: int, matrix: np.ndarray) -> pa.RecordBatch:
    kind = pa.int64() if matrix.dtype == np.int64 else pa.float64()
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(matrix)), pa.int32()), pa.array(list(matrix), pa.list_(kind))], ["i", name])


def _total(partial: DataFrame, name: str, dims: int) -> np.ndarray:
    """The sum of the tasks' matrices: cells are added in Spark, rows brought together."""
    cells = partial.select("i", F.posexplode(name).alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    found = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("r")).orderBy("i").select(F.col("r.x").alias("x")).collect()
    return np.array([r.x for r in found])


def sums(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums of their integers."""

    def run(batches):
        total = np.zeros(dims + 1, np.int64)
        for _, x in _matrices(batches, dims):
            total[:-1] += x.sum(axis=0)
            total[-1] += len(x)
        yield _summed("x", dims, total[None, :])

    total = _total(rows.select("v").mapInArrow(run, "i int, x array<long>"), "x", dims)[0]
    return int(total[-1]), total[:-1]


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - S / n: the whole part of the mean comes off in integers, a rest of at most a half in doubles."""
    whole = (2 * s + n) // (2 * n)
    return (x - whole) - (s - n * whole) / n


def gram(rows: DataFrame, dims: int, n: int, s: np.ndarray, upper: np.ndarray | None = None, right: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows, solved against an upper factor or times a matrix."""
    width = dims if right is None else right.shape[1]

    def run(batches):
        total = np.zeros((width, width))
        for _, x in _matrices(batches, dims):
            a = centred(x, n, s)
            q = np.linalg.solve(upper.T, a.T).T if right is None else a @ right
            total += q.T @ q
        yield _summed("g", dims, total)

    g = _total(rows.select("v").mapInArrow(run, "i int, g array<double>"), "g", dims)
    return (g + g.T) / 2


def factor(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of g + shift; the shift grows until there is one."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, EPS * float(np.trace(g)))


def decompose(rows: DataFrame, dims: int, n: int, s: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and unit eigenvectors as columns."""
    r, before = np.eye(dims), np.inf
    for k in range(passes):
        g = gram(rows, dims, n, s, upper=r)
        least, norm = np.linalg.eigvalsh(g)[[0, -1]]
        if norm <= 0:
            return np.zeros(dims), np.eye(dims)
        off = float(np.abs(g - np.eye(dims)).max())
        # done, or what is left are directions without spread, which no pass makes orthonormal
        if k and (off < 1e-13 or k > 2 and off > before / 2):
            break
        before = off
        if k + 1 < passes:
            needs = k == 0 or least < 1e-10 * norm
            r = np.triu(factor(g, norm * min(11 * (n * dims + dims * (dims + 1)) * EPS, 1 / 16) if needs else 0.0) @ r)
    values, basis = np.linalg.eigh(g)
    root = basis * np.sqrt(np.maximum(values, 0)) @ basis.T
    _, sigma, v = np.linalg.svd(root @ r)
    return sigma**2 / n, v.T


def components(table: DataFrame, most: int = COMPONENTS):
    """What whitens a table: its rows, dims, n, S, eigenvalues, eigenvectors and trace, or None without any row."""
    rows, dims = vectors(table)
    if not dims:
        return None
    if dims > MOST_DIMS:
        raise ValueError(f"vectors may have up to {MOST_DIMS} entries")
    n, s = sums(rows, dims)
    e, v = decompose(rows, dims, n, s)
    kept = int((np.sqrt(e[:most]) > 64 * dims * EPS * np.sqrt(e[0])).sum())
    v = v[:, :kept] * np.where(v[np.abs(v).argmax(axis=0), np.arange(dims)][:kept] < 0, -1.0, 1.0)
    return rows, dims, n, s, e[:kept], v, float(e.sum())


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """Exact sums over dimensions of (n x - S) ** 2; null where a long can't hold one."""
    most = int(n) * int(np.abs(x).max(initial=0)) + int(np.abs(s).max(initial=0))
    if most < 1 << 62:
        d = n * x - s
        if int(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (d * d).sum(axis=1).tolist()
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, s.tolist())) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component."""
    found = components(table, most)
    if found is None or not len(found[4]):
        return table.sparkSession.createDataFrame([], SCHEMA)
    rows, dims, n, s, e, v, trace = found
    scaled = v / np.sqrt(e)
    error = float(np.abs(gram(rows, dims, n, s, right=scaled) / n - np.eye(len(e))).max())
    k = len(e)

    def run(batches):
        for part, x in _matrices(batches, dims):
            m = len(x)
            w = centred(x, n, s) @ scaled
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                pa.array(deviations(x, n, s), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(e / trace, m)), pa.array(np.full(m * k, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
