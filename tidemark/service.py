"""Runs and their state as plain methods: start, status, artifacts, latest."""

from __future__ import annotations

import hmac
import os
import posixpath
import threading
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import forecast
from tidemark.sources import series as src


class Busy(RuntimeError):
    """A run is on."""


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def under(path: str, root: str) -> bool:
    """Whether path is root or below it; paths with a scheme are compared as they are written, without their dots."""

    def plain(p: str) -> str:
        scheme, mark, rest = p.rpartition("://")
        return scheme + mark + posixpath.normpath("/" + rest) if mark else os.path.realpath(p)

    path, root = plain(path), plain(root)
    return path == root or path.startswith(root.rstrip("/") + "/")


@dataclass
class Engine:
    """One forecaster over series that `load` gives; results go under `root`."""

    spark: SparkSession
    load: Callable[[SparkSession, str], DataFrame]
    root: str
    key: str | None = None
    state: dict = field(default_factory=lambda: {"running": False, "started_at": None, "finished_at": None, "error": None, "request": None})
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def _authorize(self, key: str | None) -> None:
        if self.key is not None and not hmac.compare_digest(self.key, key or ""):
            raise PermissionError("wrong key")

    def start(self, config: forecast.RunConfig, key: str | None = None, wait: bool = False, **limits) -> dict:
        """Checks everything and takes the flag in one step, then runs in the background."""
        self._authorize(key)
        folder = self._checked(config.output_dir)
        with self._lock:
            if self.state["running"]:
                raise Busy
            self.state |= {"running": True, "started_at": now(), "finished_at": None, "error": None, "request": asdict(config)}
        job = threading.Thread(target=self._run, args=(config, folder, limits), daemon=True)
        job.start()
        if wait:
            job.join()
        return {"status": "started", "request": asdict(config)}

    def _run(self, config: forecast.RunConfig, folder: str, limits: dict) -> None:
        try:
            table, scored, rows = forecast.run(self.load(self.spark, config.ticker), config, **limits)
            src.write_forecast(table, f"{folder}/forecast")
            saved = self.spark.read.parquet(f"{folder}/forecast")
            src.write_summary(forecast.summary(saved, scored, rows, config, limits.get("rounds", 200)), f"{folder}/summary")
            src.tail(rows).select("date", "close").write.mode("overwrite").parquet(f"{folder}/history")
        except Exception as e:
            self.state["error"] = str(e)
        finally:
            with self._lock:
                self.state |= {"running": False, "finished_at": now()}

    def status(self) -> dict:
        return dict(self.state)

    def health(self) -> dict:
        return {"status": "ok", "running": self.state["running"]}

    def _there(self, path: str) -> bool:
        """Whether a path exists in whatever store it names."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _checked(self, output_dir: str | None) -> str:
        path = output_dir or self.root
        if not under(path, self.root):
            raise ValueError("output_dir is outside the root")
        return path

    def artifacts(self, output_dir: str | None = None) -> list[dict]:
        folder = self._checked(output_dir)
        names = [n for n in ("forecast", "history", "summary") if self._there(f"{folder}/{n}")]
        return [r.asDict() | {"set": n} for n in names for r in src.artifacts(self.spark, f"{folder}/{n}").collect()]

    def latest(self, output_dir: str | None = None) -> dict:
        """Size, ends and summary of the last forecast of the root or a folder under it."""
        folder = self._checked(output_dir)
        if not self._there(f"{folder}/forecast"):
            raise FileNotFoundError("no forecast yet")
        table = self.spark.read.parquet(f"{folder}/forecast")
        row = table.agg(F.count("*").alias("rows"), F.min("date").cast("string").alias("start_date"), F.max("date").cast("string").alias("end_date"), F.min_by(F.struct("*"), "date").alias("first_row"), F.max_by(F.struct("*"), "date").alias("last_row")).first()
        stats = self.spark.read.text(f"{folder}/summary").first()
        return row.asDict(recursive=True) | {"stats": stats.value if stats else "{}"}
