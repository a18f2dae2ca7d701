"""Sources: CSV files and texts, Parquet, rows in memory, JSON messages and Kafka topics.

Batch readers take a path that Spark reads; streaming readers watch a folder. Malformed cells are errors. In CSV a timestamp is
a whole number of milliseconds; an empty cell and a missing last cell are null.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CatalogError, PlanError
from ..types import SPARK
from . import order

Columns = Sequence[tuple[str, str]]


@dataclass(frozen=True)
class CsvOptions:
    """delimiter: one character. batch_size: rows wanted in a batch of a stream (turned into files for each trigger)."""

    delimiter: str = ","
    has_header: bool = False
    batch_size: int = 1_000_000


def struct_of(columns: Columns) -> T.StructType:
    """The declared columns as a Spark schema."""
    return T.StructType([T.StructField(c[0], SPARK[c[1]]) for c in columns])


def _raw(columns: Columns) -> T.StructType:
    return T.StructType([T.StructField(c[0], T.LongType() if c[1] == "timestamp" else SPARK[c[1]]) for c in columns])


def _instants(df: DataFrame, columns: Columns) -> DataFrame:
    times = {c[0]: F.timestamp_millis(F.col(f"`{c[0]}`")) for c in columns if c[1] == "timestamp"}
    return df.withColumns(times) if times else df


def read_csv(spark: SparkSession, path: str, columns: Columns, options: CsvOptions = CsvOptions(), streaming: bool = False, place: bool = False) -> DataFrame:
    """place: adds the hidden column that tells the arrival order."""
    reader = (spark.readStream if streaming else spark.read).schema(_raw(columns))
    reader = reader.option("sep", options.delimiter).option("header", options.has_header).option("mode", "FAILFAST").option("enforceSchema", True)
    if streaming:
        reader = reader.option("maxFilesPerTrigger", max(1, options.batch_size // 1_000_000))
    rows = reader.csv(path)
    return _instants(order.with_place(order.with_split(rows)) if place else rows, columns)


def parse_csv(spark: SparkSession, data: bytes | str, columns: Columns, options: CsvOptions = CsvOptions()) -> DataFrame:
    """CSV text held in memory. Parsed by Spark; row order is kept by the column ``_row``."""
    text = data.decode() if isinstance(data, bytes) else data
    lines = [x for x in text.splitlines() if x]
    lines = lines[1:] if options.has_header else lines
    rows = spark.createDataFrame(list(enumerate(lines)), "_row long, line string")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _raw(columns))
    parsed = rows.select("_row", F.from_csv("line", ddl, {"sep": options.delimiter, "mode": "FAILFAST"}).alias("c"))
    return _instants(parsed.select("_row", "c.*"), columns)


def infer_csv(data: str, options: CsvOptions = CsvOptions()) -> list[tuple[str, str]]:
    """Column types from all cells of a text: quoted cells are strings, true and false booleans, digits with a point float64,
    digits int64, anything else strings. Integers with floats make float64, any other mix strings. Without a header the names
    are c1, c2 and so on. Timestamps are never inferred."""
    found: list[set[str]] = []
    names: list[str] = []
    for i, line in enumerate(x for x in data.splitlines() if x):
        raw = _cells(line, options.delimiter)
        if i == 0 and options.has_header:
            names = next(csv.reader(io.StringIO(line), delimiter=options.delimiter))
            continue
        found += [set() for _ in range(len(raw) - len(found))]
        for kinds, cell in zip(found, raw, strict=False):
            kinds.add(_kind(cell))
    names += [f"c{i + 1}" for i in range(len(names), len(found))]
    found += [{"string"} for _ in range(len(names) - len(found))]
    return [(n, next(iter(k)) if len(k) == 1 else "float64" if k == {"int64", "float64"} else "string") for n, k in zip(names, found, strict=True)]


def _cells(line: str, delimiter: str) -> list[str]:
    d = re.escape(delimiter)
    return [m[1] for m in re.finditer(rf'(?:^|(?<={d}))("(?:[^"]|"")*"|[^{d}]*)(?={d}|$)', line)]


def _kind(cell: str) -> str:
    if cell.startswith('"'):
        return "string"
    if cell in ("true", "false"):
        return "boolean"
    if re.fullmatch(r"-?\d+\.\d+", cell):
        return "float64"
    return "int64" if re.fullmatch(r"-?\d+", cell) else "string"


def parse_json(payload: Column, columns: Columns) -> Column:
    """An array of rows from a message that holds a JSON array of objects. A missing key or null is null, a value of another
    type an error. Timestamps are milliseconds."""
    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in _raw(columns))
    rows = F.from_json(payload, f"array<struct<{inner}>>", {"mode": "FAILFAST"})
    fields = lambda r: F.struct(*[(F.timestamp_millis(r[c[0]]) if c[1] == "timestamp" else r[c[0]]).alias(c[0]) for c in columns])
    return F.transform(rows, fields)


def read_json_messages(df: DataFrame, columns: Columns, payload: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The rows of all messages; keep: columns of the message to repeat for its rows, such as offsets."""
    return df.select(*keep, F.inline(parse_json(F.col(payload).cast("string"), columns)))


def read_kafka(spark: SparkSession, servers: str, topics: Sequence[str], columns: Columns, group_id: str | None = None, streaming: bool = True) -> DataFrame:
    """JSON messages of Kafka topics with ``_offset`` as arrival order in a partition. Offsets are kept by the query's
    checkpoint. Needs Spark's Kafka connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    if group_id:
        reader = reader.option("kafka.group.id", group_id)
    raw = reader.load().select("value", F.col("partition").alias("_partition"), F.col("offset").alias("_offset"))
    return read_json_messages(raw, columns, keep=("_partition", "_offset"))


def read_rows(spark: SparkSession, rows: Sequence, columns: Columns) -> DataFrame:
    return spark.createDataFrame(list(rows), struct_of(columns))


def from_uri(spark: SparkSession, uri: str, columns: Columns, streaming: bool = False, place: bool = False) -> DataFrame:
    """A source by URI: ``csv:///path?delimiter=44&has_header=true``, ``file:///path.csv``, ``parquet:///path``,
    ``kafka://servers/topic1,topic2?group_id=g``; ``json:///path`` reads lines of JSON arrays. place: files get the hidden
    column that tells the arrival order (see order)."""
    parts = urlsplit(uri)
    query = dict(parse_qsl(parts.query))
    scheme, path = parts.scheme.lower(), f"{parts.netloc}{parts.path}"
    if scheme == "csv" or path.lower().endswith(".csv"):
        if unknown := set(query) - {"delimiter", "has_header", "batch_size"}:
            raise CatalogError(f"unknown option: {', '.join(sorted(unknown))}")
        sep = query.get("delimiter", "44")
        options = CsvOptions(chr(int(sep)) if sep.isdigit() else sep, query.get("has_header", "false").lower() == "true", int(query.get("batch_size", 1_000_000)))
        base = path if scheme in ("csv", "file", "") else f"{scheme}://{path}"
        return read_csv(spark, base, columns, options, streaming, place)
    if scheme == "parquet" or path.lower().endswith(".parquet"):
        base = path if scheme in ("parquet", "file", "") else f"{scheme}://{path}"
        if streaming:
            rows = spark.readStream.schema(struct_of(columns)).parquet(base)
            return order.with_row_index(rows) if place else rows
        df = spark.read.parquet(base)
        missing = [c[0] for c in columns if c[0].lower() not in {x.lower() for x in df.columns}]
        if missing:
            raise PlanError(f"not such column: {', '.join(missing)}")
        df = order.with_row_index(df) if place else df
        return df.select(*[F.col(f"`{c[0]}`").cast(SPARK[c[1]]).alias(c[0]) for c in columns], *([order.PLACE] if place else []))
    if scheme == "json":
        lines = (spark.readStream if streaming else spark.read).text(path)
        if not place:
            return read_json_messages(lines, columns)
        return order.with_place(read_json_messages(order.with_split(lines), columns, keep=("__split",)))
    if scheme == "kafka":
        return read_kafka(spark, parts.netloc, parts.path.strip("/").split(","), columns, query.get("group_id"), streaming)
    raise CatalogError(f"unsupported source: {uri}")
