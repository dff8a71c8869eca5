"""A price source: folders of CSV files by ticker and year, as market downloads leave them.

    <path>/ticker=BTC-USD/year=1995/<any name>.csv

Each file has a header of its own: any order and number of columns, a date column first
found by name, a close (or adjusted) and perhaps a volume column, as series.normalise
finds them. So the files of a folder needn't share a header, which Spark's own reader
asks of them.

The reader plans partitions from names and sizes alone. Predicates on series_id and date
are taken over: files of other tickers and years are never opened, and dates are tested
again row by row. Files are read as batches of Arrow rows, so memory doesn't grow
with their size; a task reads whole files, of PART_BYTES together.

A ticker of null is a folder named __HIVE_DEFAULT_PARTITION__. Empty files and files of
a header alone give no rows; rows without a readable date, close or volume have nulls there. A header
without a date or close column is an error. Repeated rows stay. A folder that isn't
there or is empty gives no rows.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Iterator
from csv import reader as csv_rows
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tidemark.sources.series import shared_folder

SCHEMA = "series_id string, date date, close double, volume double"
PART_BYTES = 32 << 20
OPEN_BYTES = 1 << 20  # what opening a file counts for
NO_TICKER = "__HIVE_DEFAULT_PARTITION__"
_RANGES = (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


@dataclass
class Listed:
    """A file of the folder; year is None where its name doesn't tell one."""

    path: str
    size: int
    ticker: str | None
    year: int | None


@dataclass
class Files(InputPartition):
    files: list[Listed] = field(default_factory=list)


def file_system(path: str):
    """The file system of a path and the path in it, by pyarrow; s3a and s3n are its s3."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or not re.fullmatch(r"[a-z][a-z0-9+.-]*", scheme):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def listed(path: str) -> list[Listed]:
    """The CSV files below a folder with what their names tell; names that start with _ or . don't count."""
    from pyarrow import fs as kinds

    fs, root = file_system(path)
    found = []
    for info in fs.get_file_info(kinds.FileSelector(root, recursive=True, allow_not_found=True)):
        names = info.path.removeprefix(root).strip("/").split("/")
        if info.type != kinds.FileType.File or not names[-1].endswith(".csv") or any(n[0] in "_." for n in names):
            continue
        keys = dict(n.split("=", 1) for n in names[:-1] if "=" in n)
        if "ticker" not in keys:
            raise ValueError(f"{info.path}: no folder ticker=...")
        ticker, year = unquote(keys["ticker"]), keys.get("year", "")
        found.append(Listed(info.path, info.size, None if ticker == NO_TICKER else ticker, int(year) if year.isdigit() else None))
    return sorted(found, key=lambda f: f.path)


def _holds(f: Filter, value) -> bool:
    """Whether a value passes a predicate; null passes none."""
    if value is None or isinstance(f, IsNotNull):
        return value is not None
    match f:
        case EqualTo():
            return value == f.value
        case In():
            return value in f.value
        case GreaterThan():
            return value > f.value
        case GreaterThanOrEqual():
            return value >= f.value
        case LessThan():
            return value < f.value
        case LessThanOrEqual():
            return value <= f.value
    raise TypeError(f"{f} isn't a predicate of this source")


def _may_hold(f: Filter, first: datetime.date, last: datetime.date) -> bool:
    """Whether any date from first to last can pass a predicate."""
    match f:
        case EqualTo():
            return first <= f.value <= last
        case In():
            return any(v is not None and first <= v <= last for v in f.value)
        case GreaterThan() | GreaterThanOrEqual():
            return _holds(f, last)
        case LessThan() | LessThanOrEqual():
            return _holds(f, first)
    return True


def _place(names: list[str], what: str, *needles: str, required: bool = True) -> int | None:
    at = next((i for i, n in enumerate(names) if any(x in n.strip().lower() for x in needles)), None)
    if at is None and required:
        raise ValueError(f"no {what} column among {', '.join(names)}")
    return at


class PriceReader(DataSourceReader):
    """Plans and reads files; takes predicates over where `pushdown` says so."""

    def __init__(self, path: str, adjusted: bool):
        self.path, self.adjusted = path, adjusted
        self.tests: dict[str, list[Filter]] = {"series_id": [], "date": []}

    def chosen(self) -> list[Listed]:
        """The files that can have a row that passes the predicates."""
        kept = []
        for f in listed(self.path):
            years = None if f.year is None else (datetime.date(f.year, 1, 1), datetime.date(f.year, 12, 31))
            if all(_holds(t, f.ticker) for t in self.tests["series_id"]) and (years is None or all(_may_hold(t, *years) for t in self.tests["date"])):
                kept.append(f)
        return kept

    def partitions(self) -> list[Files]:
        parts, size = [Files()], 0
        for f in self.chosen():
            if parts[-1].files and size + f.size + OPEN_BYTES > PART_BYTES:
                parts.append(Files())
                size = 0
            parts[-1].files.append(f)
            size += f.size + OPEN_BYTES
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for f in partition.files:
            if f.size:
                with fs.open_input_stream(f.path) as stream:
                    yield from self._batches(stream, f)

    def _batches(self, stream, f: Listed) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyarrow import csv

        header = b""
        while not header.endswith(b"\n") and (byte := stream.read(1)):
            header += byte
        names = next(csv_rows([header.decode("utf-8-sig").rstrip("\r\n")]), [""])
        day = _place(names, "date", "date")
        close = _place(names, "close", *(("close", "adj") if self.adjusted else ("close",)))
        volume = _place(names, "volume", "volume", required=False)
        columns = [f"c{i}" for i in range(len(names))]
        wanted = [columns[i] for i in (day, close, volume) if i is not None]
        try:
            reader = csv.open_csv(stream, csv.ReadOptions(column_names=columns, use_threads=False), convert_options=csv.ConvertOptions(column_types={c: pa.string() for c in columns}, include_columns=wanted, strings_can_be_null=True))
        except pa.ArrowInvalid as e:
            if "Empty CSV file" in str(e):
                return
            raise
        out = pa.schema([("series_id", pa.string()), ("date", pa.date32()), ("close", pa.float64()), ("volume", pa.float64())])

        def number(x: pa.Array) -> pa.Array:
            good = pc.match_substring_regex(x, r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$")
            return pc.cast(pc.utf8_trim_whitespace(pc.if_else(good, x, None)), pa.float64())

        for batch in reader:
            days = pa.array([_day(x) for x in batch.column(columns[day]).to_pylist()], pa.date32())
            volumes = number(batch.column(columns[volume])) if volume is not None else pa.array([0.0] * len(batch))
            rows = pa.RecordBatch.from_arrays([pa.array([f.ticker] * len(batch), pa.string()), days, number(batch.column(columns[close])), volumes], schema=out)
            if self.tests["date"]:
                rows = rows.filter(pa.array([all(_holds(t, d) for t in self.tests["date"]) for d in days.to_pylist()], pa.bool_()))
            yield rows


def _day(text: str | None) -> datetime.date | None:
    """The day that a text starts with."""
    try:
        return None if text is None else datetime.date.fromisoformat(text.strip()[:10])
    except ValueError:
        return None


class FilteredPriceReader(PriceReader):
    """Takes predicates over. Spark keeps them with the loaded relation, so each relation serves one set of them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull, *_RANGES)) and len(f.attribute) == 1 else None
            if column in self.tests:
                self.tests[column].append(f)
            else:
                yield f


class Prices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tickers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PriceReader:
        kind = FilteredPriceReader if self.options.get("pushdown", "false").lower() == "true" else PriceReader
        return kind(self.options["path"], self.options.get("adjusted", "false").lower() == "true")


def write(prices: DataFrame, path: str) -> None:
    """Writes series_id, date, close, volume as a file for each ticker and year; Spark's commit leaves out files of lost tasks."""
    rows = prices.select(F.col("series_id").alias("ticker"), F.year("date").alias("year"), "date", "close", "volume")
    rows.repartition("ticker", "year").sortWithinPartitions("ticker", "year", "date").write.partitionBy("ticker", "year").csv(path, header=True, mode="overwrite")


def read(spark: SparkSession, path: str, where: Column | str | None = None, adjusted: bool = False) -> DataFrame:
    """series_id, date, close, volume of a folder; `where` is pushed down as far as it compares series_id or date with constants.

    Spark pushes predicates down when it plans a query, so with `where` the session keeps
    spark.sql.python.filterPushdown.enabled on.
    """
    spark.dataSource.register(Prices)
    if where is not None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("tickers").option("adjusted", str(adjusted)).option("pushdown", str(where is not None)).load(path)
    return found if where is None else found.where(where)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tickers-{uuid.uuid4().hex}"
