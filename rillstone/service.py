"""Statements over a catalog: define sources, streams and sinks, start and stop streams, and run selects."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .errors import CatalogError
from .operators.frame import StreamFrame
from .sources import readers, sinks
from .sql.parser import CreateSink, CreateSource, CreateStream, Delete, Select, Show, Start, Stop, parse_expr, parse_select, parse_statement
from .sql.planner import plan
from .streaming import runtime


@dataclass
class Metrics:
    """Milliseconds since the epoch, and rows read and returned."""

    start: int
    end: int
    input_rows: int
    output_rows: int


class Service:
    """Executes statements. Each started stream is a streaming query of its own; the session's zone is set to UTC."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark, self.catalog = spark, Catalog(data_dir, spark)
        self.running: dict[str, object] = {}
        self.sinks: dict[str, sinks.Sink] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def execute(self, text: str) -> DataFrame:
        """A select's result, the list of a SHOW statement, or one row (action, success)."""
        s = parse_statement(text)
        if isinstance(s, Select):
            return self.select(s).to_df()
        if isinstance(s, Show):
            return self.show(s.kind)
        action = getattr(self, f"_{type(s).__name__.lower()}")(s)
        return self.spark.createDataFrame([(action, True)], "action string, success boolean")

    def batches(self, text: str, size: int = 1000) -> Iterator[tuple[list[str], list] | Metrics]:
        """A select's result for a prompt or a client: (columns, rows) by batch, then the metrics, counted while it runs. The
        driver holds one partition of the result at a time; a reader that stops early stops the rest."""
        began = int(time.time() * 1000)
        counted: list[str] = []
        df = plan(parse_select(text), lambda name, alias: self.source(name, alias, counted=counted)).to_df()
        rows, n = df.toLocalIterator(), 0
        while batch := list(islice(rows, size)):
            n += len(batch)
            yield df.columns, batch
        seen = df._jdf.queryExecution().observedMetrics()
        yield Metrics(began, int(time.time() * 1000), sum(seen.apply(name).getLong(0) for name in counted), n)

    def query(self, text: str) -> tuple[list, Metrics]:
        """A select's rows and metrics."""
        *parts, metrics = self.batches(text)
        return [r for _, rows in parts for r in rows], metrics

    def select(self, query: Select) -> StreamFrame:
        return plan(query, self.source)

    def source(self, name: str, alias: str | None = None, streaming: bool = False, counted: list[str] | None = None) -> StreamFrame:
        d = self.catalog.get("source", name)
        df = readers.from_uri(self.spark, d["uri"], [tuple(c) for c in d["columns"]], streaming, place=not d.get("order"))
        if counted is not None:
            counted.append(f"source{len(counted)}")
            df = df.observe(counted[-1], F.count(F.lit(1)).alias("rows"))
        at = parse_expr(d["time"]) if d.get("time") else None
        return StreamFrame.source(df, time=at, seq=d.get("order"), qualifier=alias or name)

    # -- definitions -------------------------------------------------------------------------------------------------

    def _createsource(self, s: CreateSource) -> str:
        self.catalog.create("source", s.name, uri=s.uri, columns=s.columns, time=s.time_text, order=s.order)
        return "create source"

    def _createstream(self, s: CreateStream) -> str:
        self.catalog.create("stream", s.name, query=s.text, to=s.sink)
        return "create stream"

    def _createsink(self, s: CreateSink) -> str:
        self.catalog.create("sink", s.name, uri=s.uri, format=s.format)
        return "create sink"

    def _delete(self, s: Delete) -> str:
        if s.kind == "stream":
            self.catalog.get("stream", s.name)
            self._halt(s.name)
        self.catalog.delete(s.kind, s.name)
        return f"delete {s.kind}"

    # -- streams -----------------------------------------------------------------------------------------------------

    def _start(self, s: Start) -> str:
        d = self.catalog.get("stream", s.name)
        if self.is_running(s.name):
            raise CatalogError(f"stream '{s.name}' is running")
        if s.restart:
            self.catalog.clear_checkpoint(s.name)
        to = self.catalog.get("sink", d["to"])
        sink = self.sinks.get(s.name.lower()) or sinks.from_uri(self.spark, to["uri"], to.get("format"))
        self.sinks[s.name.lower()] = sink
        select, sources = parse_select(d["query"]), lambda n, a: self.source(n, a, streaming=True)
        query = runtime.start(select, sources, sink, self.catalog.checkpoint(s.name), s.name, once=s.once)
        self.running[s.name.lower()] = query
        self.catalog.set_state(s.name, "started")
        if s.once:
            self._to_end(s.name, query, lambda: runtime.finish(select, sources, sink, self.catalog.checkpoint(s.name)))
        return "restart stream" if s.restart else "start stream"

    def _to_end(self, name: str, query, finish) -> None:
        """Waits until the stream has read what is there, then emits the windows left open: the stream is finished."""
        try:
            query.awaitTermination()
            finish()
        finally:
            self._halt(name)
        self.catalog.set_state(name, "finish")

    def _stop(self, s: Stop) -> str:
        self.catalog.get("stream", s.name)
        if not self.is_running(s.name):
            raise CatalogError(f"stream '{s.name}' is not running")
        self._halt(s.name)
        return "stop stream"

    def _halt(self, name: str) -> None:
        query = self.running.pop(name.lower(), None)
        if query is None:
            return
        failed = query.exception()
        query.stop()
        self.catalog.set_state(name, "error" if failed else "stop", str(failed) if failed else None)

    def is_running(self, name: str) -> bool:
        query = self.running.get(name.lower())
        return bool(query and query.isActive)

    def status(self, name: str) -> str:
        query = self.running.get(name.lower())
        if query is not None and not query.isActive:
            self._halt(name)
        state = self.catalog.state(name)
        return f"error: {state['message']}" if state["state"] == "error" else state["state"]

    def show(self, kind: str) -> DataFrame:
        every = self.catalog.list(kind)
        if kind == "stream":
            return self.spark.createDataFrame([(d["name"], d["to"], self.status(d["name"])) for d in every], "name string, to string, status string")
        return self.spark.createDataFrame([(d["name"], d["uri"]) for d in every], "name string, uri string")

    def close(self) -> None:
        for name in list(self.running):
            self._halt(name)
