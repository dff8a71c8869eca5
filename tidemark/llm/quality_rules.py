"""Quality rules: counts of every text, and robust multivariate outliers.

Each text becomes a vector of transformed statistics. For every language and
source the minimum covariance determinant estimate gives location and scatter:
from two robust starts, concentration steps refit on the share `support` of rows
with the smallest distances, and the start with the smaller determinant wins.
Rows are rejected beyond a bound on the squared Mahalanobis distance per dimension.
Cells with fewer than `least` rows take the estimate of their language, and
languages with fewer that of all rows. All passes are grouped sums, so no group
meets in one task. A floor on each variance keeps exact-fit groups regular.

Null and empty texts have no words and fail the base rule. Null languages and
sources are groups of their own. Rows that repeat are judged alike. An empty
table gives an empty result. Only doc_id, text, lang and source are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

SYMBOLS = "#*$%&|<>"
STATS = ("size", "word_length", "symbols", "marks", "capitals", "digits", "repeats", "dup_lines", "variety")
#: Least standard deviation of each statistic that counts as spread.
FLOORS = (0.6, 0.12, 0.04, 0.06, 0.08, 0.25, 0.12, 0.15, 0.12)
SUPPORT = 0.75
LEAST = 200
STEPS = 3
#: Squared distance per dimension beyond which a row goes; far in the tail, as statistics of clean text aren't normal.
BOUND = 7.0
SALTS = 64
MOST_CELLS = 20_000  # cells whose estimates may be broadcast: 20,000 x 100 doubles are 16 MB
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_in_rows(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of size items are in a window that starts where starts is true."""
    delta = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(starts)
    delta[at] += 1
    delta[at + width] -= 1
    return np.cumsum(delta[:-1]) > 0


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_counts(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of each text, and its transformed statistics."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    flat, offsets = tx.words(texts)
    codes, distinct = tx.coded(flat)
    n = np.diff(offsets)
    hashes, chars = tx.hashed(distinct)[codes], np.asarray(pc.utf8_length(distinct)).astype(np.int64)[codes]
    row = tx.row_of(offsets)
    keys = tx.windows_hash(hashes, 5)
    inside = row[: len(keys)] == row[len(row) - len(keys) :]
    keys = tx.mixed(keys ^ (row[: len(keys)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    again = np.zeros(len(keys), bool)
    again[inside] = repeated_in_rows(keys[inside])
    repeat = covered(again, 5, len(row))
    first = np.zeros(len(row), bool)
    if len(row):
        pair = row.astype(np.int64) * max(1, len(distinct)) + codes
        first[np.unique(pair, return_index=True)[1]] = True
    symbols = sum(np.asarray(pc.count_substring(texts, c)).astype(np.int64) for c in SYMBOLS)
    marks = np.asarray(pc.count_substring_regex(texts, r"[!?*#$%&|<>=~^_{}\[\]\\]")).astype(np.int64)
    capitals = np.asarray(pc.count_substring_regex(texts, r"\p{Lu}")).astype(np.int64)
    digits = np.asarray(pc.count_substring_regex(texts, r"[0-9]")).astype(np.int64)
    dup, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts.to_pylist()):
        full = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        lines[i], dup[i] = len(full), len(full) - len(set(full))
    counts = {"n_words": n, "word_chars": per_row(chars, offsets), "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": per_row(repeat, offsets)}
    size, chars_n = np.maximum(n, 1), np.maximum(counts["word_chars"], 1)
    stats = np.column_stack(
        [
            np.log1p(n), np.log(chars_n / size), np.sqrt(symbols / chars_n), np.sqrt(marks / chars_n), np.sqrt(capitals / chars_n),
            np.sqrt(digits / chars_n), np.sqrt(counts["n_repeat_words"] / size), np.sqrt(dup / np.maximum(lines, 1)), np.log(np.maximum(per_row(first, offsets), 1)) / np.log(size + 1.5),
        ]
    )
    return counts, stats


def _measured(batches):
    for block in tx.blocks(batches):
        counts, stats = text_counts(tx.column(block, "text"))
        cols = [tx.column(block, c) for c in ("doc_id", "rid", "lang", "source")] + [pa.array(v.astype(np.int64)) for v in counts.values()] + [pa.array(stats[:, i]) for i in range(len(STATS))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rid", "lang", "source", *counts, *STATS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, rid, lang, source, the base counts and the statistics of every row."""
    own = {c.lower() for c in docs.columns}
    docs = tx.documents(docs, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in own else F.lit("").alias(c) for c in ("lang", "source")])
    docs = docs.withColumn("rid", tx.row_key(docs))
    return docs.mapInArrow(_measured, "doc_id long, rid long, lang string, source string, " + COUNTS + ", " + ", ".join(f"{s} double" for s in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of the statistics, by the inverse Cholesky factor in `{prefix}root`."""
    p = len(STATS)
    centred = [F.col(s) - F.col(f"{prefix}centre")[i] for i, s in enumerate(STATS)]
    rows = [reduce(lambda a, b: a + b, [F.col(f"{prefix}root")[i * p + j] * centred[j] for j in range(i + 1)]) for i in range(p)]
    return reduce(lambda a, b: a + b, [r * r for r in rows])


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    p = len(STATS)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    cols = [F.count("*").alias("n")] + [F.avg(s).alias(f"m{i}") for i, s in enumerate(STATS)] + [F.avg(F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}_{j}") for i, j in pairs]

    def factor(frames):
        for pdf in frames:
            yield _factors(pdf, keys)

    return rows.groupBy(*keys).agg(*cols).mapInPandas(factor, _fit_schema(keys))


def _fit_schema(keys: list[str]) -> str:
    return ", ".join(f"{k} {'int' if k == 'start' else 'string'}" for k in keys) + ", n long, centre array<double>, root array<double>, log_det double"


def _factors(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    p = len(STATS)
    mean = pdf[[f"m{i}" for i in range(p)]].to_numpy(float)
    cov = np.zeros((len(pdf), p, p))
    for i in range(p):
        for j in range(i + 1):
            cov[:, i, j] = cov[:, j, i] = pdf[f"q{i}_{j}"].to_numpy(float) - mean[:, i] * mean[:, j]
    floor = np.square(FLOORS)
    cov += np.diag(floor)
    low = np.linalg.cholesky(cov) if len(pdf) else cov
    root = np.linalg.inv(low) if len(pdf) else cov
    out = pdf[[*keys, "n"]].copy()
    out["centre"] = list(mean)
    out["root"] = list(root.reshape(len(pdf), -1))
    out["log_det"] = 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1) if len(pdf) else []
    return out


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts of each cell: median with spread, and the trimmed middle of the distances to it."""
    agg = [F.count("*").alias("n")]
    for i, s in enumerate(STATS):
        agg.append(F.percentile_approx(s, [0.25, 0.5, 0.75], 500).alias(f"p{i}"))

    def build(frames):
        p = len(STATS)
        for pdf in frames:
            out = []
            for k, n, *qs in pdf[["cell", "n", *[f"p{i}" for i in range(p)]]].itertuples(index=False):
                q = np.array([np.asarray(x, float) for x in qs])
                for start, width in enumerate((1.349, 4.0)):  # interquartile range of a normal; a wide one that lets correlated rows in
                    sd = np.sqrt(np.square((q[:, 2] - q[:, 0]) / width) + np.square(FLOORS))
                    out.append((k, start, n, q[:, 1], np.diag(1 / sd).ravel(), 2 * np.log(sd).sum()))
            yield pd.DataFrame(out, columns=["cell", "start", "n", "centre", "root", "log_det"])

    return rows.groupBy("cell").agg(*agg).mapInPandas(build, _fit_schema(["cell", "start"]))


def _joined(rows: DataFrame, fits: DataFrame, n_cells: int, how: str = "inner") -> DataFrame:
    """Each row with its cell's fits: broadcast while their number is bounded, else over salted keys."""
    fits = fits.select("cell", "start", "centre", "root", "log_det")
    if n_cells <= MOST_CELLS:
        return rows.join(F.broadcast(fits), "cell", how)
    fits = fits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(fits, ["cell", "salt"], how).drop("salt")


def estimates(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> tuple[DataFrame, int]:
    """Minimum covariance determinant fits (cell, centre, root, log_det, scale) of rows with a column cell."""
    fits = tx.checkpoint(_starts(rows))
    n_cells = fits.count() // 2
    for _ in range(steps):
        seen = _joined(rows, fits, n_cells).withColumn("d", distance())
        bounds = seen.groupBy("cell", "start").agg(F.percentile_approx("d", support, 1000).alias("bound"))
        if n_cells <= MOST_CELLS:
            kept = seen.join(F.broadcast(bounds), ["cell", "start"]).where("d <= bound")
        else:
            bounds = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            kept = seen.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(bounds, ["cell", "start", "salt"]).where("d <= bound")
        fits = tx.checkpoint(_moments(kept, ["cell", "start"]))
    best = fits.groupBy("cell").agg(F.min_by(F.struct("start", "centre", "root", "log_det"), F.struct("log_det", "start")).alias("f")).select("cell", "f.*")
    return best, n_cells


def judge(docs: DataFrame, bound: float = BOUND, least: int = LEAST) -> DataFrame:
    """doc_id, rid, the base counts, base_failed, distance (squared, per dimension) and kept of every row."""
    rows = tx.checkpoint(measure(docs))
    rows = rows.withColumn("base_failed", base_failed())
    sizes = rows.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy("lang").agg(F.sum("n").alias("m"))
    cells = sizes.join(by_lang, "lang").select("lang", "source", F.when(F.col("n") >= least, F.concat_ws("\x01", F.lit("c"), "lang", "source")).when(F.col("m") >= least, F.concat_ws("\x01", F.lit("l"), "lang")).otherwise("all").alias("cell"))
    cells = tx.checkpoint(cells)
    n_cells = cells.count()
    good = rows.where("not base_failed").select("rid", "lang", "source", *STATS)
    # a row counts in its own cell, in its language and in the whole: small cells fall back to the wider fits
    levels = [F.concat_ws("\x01", F.lit("c"), "lang", "source"), F.concat_ws("\x01", F.lit("l"), "lang"), F.lit("all")]
    wanted = cells.select("cell").distinct()
    spread = good.select("rid", *STATS, F.explode(F.array(*levels)).alias("cell"))
    spread = spread.join(F.broadcast(wanted), "cell", "left_semi") if n_cells <= MOST_CELLS else spread.join(wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), (spread["cell"] == wanted["cell"]) & (F.pmod("rid", F.lit(SALTS)) == F.col("salt")), "left_semi")
    fits, n_fits = estimates(spread)
    fits = cells.join(fits, "cell").drop("cell")
    p = len(STATS)
    if n_cells <= MOST_CELLS:
        seen = rows.join(F.broadcast(fits), ["lang", "source"], "left")
    else:
        fits = fits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        seen = rows.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(fits, ["lang", "source", "salt"], "left")
    seen = seen.withColumn("distance", F.when(~F.col("base_failed"), distance() / p))
    return seen.select("doc_id", "rid", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= bound)).alias("kept"))


def clean(docs: DataFrame, bound: float = BOUND) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    key = tx.private(docs, "row_key")
    kept = judge(docs, bound).where("kept").select(F.col("rid").alias(key)).distinct()
    return docs.withColumn(key, tx.raw_key()).join(kept, key, "left_semi").drop(key)
