"""Sinks: console, memory tables, and files, for bounded results and for streams."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..display import rows_text
from ..errors import CatalogError

FILE_FORMATS = ("parquet", "csv", "json", "orc")


class Sink:
    """Where result batches go. ``send`` takes a bounded DataFrame; batch ids make replays of a batch harmless where the
    target can replace what it has of it."""

    def send(self, df: DataFrame, batch: int = 0) -> None:
        raise NotImplementedError


class Console(Sink):
    """Prints whole batches as tables of at most ``rows`` rows each; rows come to the driver by partition."""

    def __init__(self, rows: int = 100, write: Callable[[str], None] = print):
        self.rows, self.write = rows, write

    def send(self, df: DataFrame, batch: int = 0) -> None:
        rows, some = df.toLocalIterator(), False
        while part := list(islice(rows, self.rows)):
            self.write(rows_text(df.columns, part))
            some = True
        if not some:
            self.write(rows_text(df.columns, []))


class Memory(Sink):
    """Appends batches to a temporary view, for tests and small results."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.parts = spark, name, {}

    def send(self, df: DataFrame, batch: int = 0) -> None:
        self.parts[batch] = self.spark.createDataFrame(df.collect(), df.schema)
        out = None
        for part in self.parts.values():
            out = part if out is None else out.unionByName(part)
        out.createOrReplaceTempView(self.name)


class Files(Sink):
    """Writes each batch to a folder of its own below the path; a replayed batch replaces its folder."""

    def __init__(self, path: str, format: str):
        self.path, self.format = path.rstrip("/"), format

    def send(self, df: DataFrame, batch: int = 0) -> None:
        df.write.mode("overwrite").format(self.format).save(f"{self.path}/batch={batch}")


def from_uri(spark: SparkSession, uri: str, format: str | None = None) -> Sink:
    """``console://``, ``memory://name``, ``parquet:///path``, ``csv:///path``, ``json:///path``, or ``file:///path`` with a format."""
    parts = urlsplit(uri)
    scheme, path = parts.scheme.lower(), f"{parts.netloc}{parts.path}"
    if scheme == "console":
        return Console()
    if scheme == "memory":
        return Memory(spark, parts.netloc or path.strip("/"))
    if scheme in FILE_FORMATS:
        return Files(path, scheme)
    if scheme == "file" and (format or "parquet") in FILE_FORMATS:
        return Files(path, format or "parquet")
    raise CatalogError(f"unsupported sink: {uri}")
