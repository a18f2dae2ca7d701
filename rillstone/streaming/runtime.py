"""Continuous queries on Structured Streaming.

Projections and filters, also with running functions (kept in Spark's state store), run as one streaming query. Where all that is
stateful are aggregates along one series of all rows, each micro-batch is handled like a bounded table, in buckets of its order,
and goes on from one row that the batch before left beside the checkpoint, so no task sees a batch whole.

A windowed aggregate runs exactly as over a bounded table: rows are late against a watermark that rises with every row, and a
window closes when the watermark has passed its end. Each micro-batch merges the partial aggregates of open windows, written
beside the query's checkpoint, with its own, emits windows that are closed, and writes those still open. State folders are
named by batch, so a repeated batch reads what it read before. ``finish`` emits the windows left open.

``native_aggregate`` is the built-in alternative: Spark's watermark, which rises by batch and closes a window as soon as it
reaches its end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import expr as E
from .. import storage
from ..operators.frame import SEQ, StreamFrame
from ..sources import order as places
from ..operators.window import Window, end_of, running_max, with_start
from ..functions.registry import lookup
from ..plans.compile import TIME, Compiler, Field, Series, find, quoted
from ..plans.prefix import Carry
from ..sources.sinks import Sink
from ..sql.parser import Select
from ..sql.planner import plan


def aggregate_of(query: Select) -> Select | None:
    """The innermost windowed aggregate of a select."""
    if query.source.query is not None and (inner := aggregate_of(query.source.query)):
        return inner
    return query if query.window is not None else None


def kinds_of(query: Select) -> set[str]:
    """The kinds of the functions that a select calls."""

    def kinds(e: E.Expr) -> set[str]:
        own = {lookup(e.namespace, e.name).kind} if isinstance(e, E.Call) else set()
        return own.union(*map(kinds, E.children(e)))

    below = kinds_of(query.source.query) if query.source.query is not None else set()
    return below.union(*map(kinds, [*query.items, *(e for e in (query.where, query.having) if e is not None)]))


class WindowState:
    """What one streaming aggregate holds after each batch, in a folder: groups of open windows, and the watermark."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _of(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def last(self) -> int:
        """The last batch; -1 before the first one."""
        return max((int(n.removeprefix("batch=")) for n in storage.names(self.spark, self.path)), default=-1)

    def read(self, batch: int, schema: T.StructType) -> tuple[DataFrame | None, object]:
        """The groups and the watermark that the batch before left."""
        at = self._of(batch - 1)
        if not storage.exists(self.spark, f"{at}/mark/_SUCCESS"):
            return None, None
        return self.spark.read.schema(schema).parquet(f"{at}/groups/open"), self.spark.read.parquet(f"{at}/mark").first()[0]

    def write(self, batch: int, groups: DataFrame, closed: Column, mark) -> DataFrame:
        """Writes the groups still open and the watermark; returns the closed ones. Every group is computed once."""
        at = self._of(batch)
        groups.withColumn("__at", F.when(closed, "closed").otherwise("open")).write.mode("overwrite").partitionBy("__at").parquet(f"{at}/all")
        every = self.spark.read.schema(groups.schema.add("__at", "string")).parquet(f"{at}/all")
        every.where("__at = 'open'").drop("__at").write.mode("overwrite").parquet(f"{at}/groups/open")
        self.spark.range(1).select(F.lit(mark).cast("timestamp").alias("mark")).write.mode("overwrite").parquet(f"{at}/mark")
        storage.remove(self.spark, self._of(batch - 3))
        return every.where("__at = 'closed'").drop("__at")


def parts_of(name: str, part: tuple[str, Column, str], seq: Column) -> dict[str, tuple[Column, Callable, Callable]]:
    """For each part of an aggregate: its value over rows, how parts merge, and at the key ``""`` how the aggregate comes of them."""
    function, x, kind = part
    pair = F.struct(seq.alias("seq"), x.alias("x"))
    some = F.when(x.isNotNull(), pair)
    floats = F.when(~F.isnan(x), x) if kind in ("float32", "float64") else x
    total, n = (F.sum(x), F.sum), (F.count(x), F.sum)
    made = {
        "sum": {"s": total}, "count": {"n": n}, "avg": {"s": total, "n": n}, "max": {"m": (F.max(floats), F.max)}, "min": {"m": (F.min(floats), F.min)},
        "first": {"p": (F.min(some), F.min)}, "last": {"p": (F.max(some), F.max)}, "row": {"p": (F.max(pair), F.max)},
    }[function]
    return {f"{name}_{k}": v for k, v in made.items()}


def whole_of(name: str, part: tuple[str, Column, str]) -> Column:
    """The aggregate from its merged parts."""
    c = lambda k: F.col(f"{name}_{k}")
    return {
        "sum": lambda: F.coalesce(c("s"), F.lit(0.0)), "count": lambda: c("n"), "max": lambda: c("m"), "min": lambda: c("m"),
        "avg": lambda: F.when(c("n") > 0, c("s") / F.when(c("n") > 0, c("n"))).otherwise(F.lit(float("nan"))),
        "first": lambda: c("p")["x"], "last": lambda: c("p")["x"], "row": lambda: c("p")["x"],
    }[part[0]]()


class WindowedBatches:
    """Steps a windowed aggregate from micro-batch to micro-batch. State is a row of merged parts for each open group; rows are
    held only where a function along the rows of a window needs them."""

    def __init__(self, below: StreamFrame, query: Select, state: WindowState):
        self.fields, self.query, self.state = list(below.fields), query, state
        scalar = Compiler(self.fields, "scalar")
        self.time = quoted(find(self.fields, TIME, None).source)
        self.value = self.time if query.watermark is None else F.coalesce(scalar.compile(query.watermark).column, self.time)
        self.keys = {f"__group{i}": scalar.compile(k).column for i, k in enumerate(query.group_by)}
        self.groups = ["__start", *self.keys]
        self.compiler = Compiler(self.fields, "grouped", Series(SEQ, [F.col(g) for g in self.groups]))
        items = StreamFrame(below._df, self.fields)._expand(query.items)
        self.typed = [(self.compiler.compile(e), e.output_name()) for e in items]
        self.out_fields = [*[Field(n, t.type) for t, n in self.typed], Field(TIME, "timestamp")]
        self.merged = all(self.compiler.parts.values())

    def _held(self, rows: DataFrame) -> DataFrame:
        """What a batch's rows in windows add to the state."""
        df = rows.withColumns(self.keys) if self.keys else rows
        if not self.merged:
            return df
        made = [f.alias(n) for name, part in self.compiler.parts.items() for n, (f, _) in parts_of(name, part, F.col(SEQ)).items()]
        return df.groupBy(*self.groups).agg(*made, F.max(SEQ).alias("__last"))

    def _joined(self, held: DataFrame, fresh: DataFrame) -> DataFrame:
        both = held.unionByName(fresh)
        if not self.merged:
            return both
        made = [merge(F.col(n)).alias(n) for name, part in self.compiler.parts.items() for n, (_, merge) in parts_of(name, part, F.lit(0)).items()]
        return both.groupBy(*self.groups).agg(*made, F.max("__last").alias("__last"))

    def step(self, batch: DataFrame, number: int, final: bool = False) -> DataFrame:
        """The windows that close with this batch; at the end all that are open."""
        w = self.query.window
        marked = running_max(batch, self.value, SEQ, "__mark")
        fresh = with_start(marked, self.time, w, "__start")
        held, last = self.state.read(number, self._held(fresh).schema)
        top = batch.agg(F.max(self.value)).first()[0]
        top = max((x for x in (top, last) if x is not None), default=None)
        late = F.col("__mark") if last is None else F.greatest(F.col("__mark"), F.lit(last))
        fresh = self._held(fresh.where(self.time >= late))
        groups = fresh if held is None else self._joined(held, fresh)
        closed = F.lit(True) if final else F.coalesce(F.lit(top).cast("timestamp") > end_of(F.col("__start"), w), F.lit(False))
        return self._finished(self.state.write(number, groups, closed, top))

    def _finished(self, groups: DataFrame) -> DataFrame:
        c = self.compiler
        if self.merged:
            grouped = groups.withColumns({name: whole_of(name, part) for name, part in c.parts.items()}) if c.parts else groups
        else:
            grouped = c.apply(groups).groupBy(*self.groups).agg(*c.aggregates.values(), F.max(SEQ).alias("__last"))
        return grouped.select(*[t.column.alias(n) for t, n in self.typed], F.col("__start").alias(TIME), F.struct("__start", "__last").alias(SEQ))


def _rest(query: Select, inner: Select, frame: StreamFrame) -> StreamFrame:
    """What a select does with the result of its innermost aggregate."""
    if query is not inner:
        below = _rest(query.source.query, inner, frame).renamed(query.source.alias)
        return plan(Select(query.items, query.source.__class__(name="__inner"), query.where, query.group_by, query.having, query.window, query.watermark), lambda name, alias: below)
    return frame.filter(query.having) if query.having is not None else frame


def start(query: Select, sources: Callable[[str, str | None], StreamFrame], sink: Sink, checkpoint: str, name: str, once: bool = False) -> StreamingQuery:
    """Starts a select over streaming sources. once: handles what is there, then stops."""
    inner = aggregate_of(query)
    if inner is None:
        frame = plan(query, sources)
        df = frame.to_df()
        send = lambda batch, number: sink.send(batch, number)
        spark = df.sparkSession
        # a checkpoint with a state store is of a query that was begun with it and goes on with it
        if not frame._keys and kinds_of(query) - {"scalar"} == {"aggregate"} and not storage.exists(spark, f"{checkpoint.rstrip('/')}/state"):
            leaf = query
            while leaf.source.query is not None:
                leaf = leaf.source.query
            below = sources(leaf.source.name, leaf.source.alias)
            df = below._df

            def send(batch: DataFrame, number: int) -> None:
                batch, span = numbered(batch, number, below.by_column)
                carry = Carry(spark, f"{checkpoint.rstrip('/')}/running", number, span)
                rows = StreamFrame(batch, below.fields, by_column=below.by_column, carry=carry)
                sink.send(plan(query, lambda name, alias: rows).to_df(), number)
    else:
        base = Select([E.Wildcard()], inner.source, inner.where)
        below = plan(base, sources)
        spark = below._df.sparkSession
        df = below._df
        steps = WindowedBatches(below, inner, WindowState(spark, f"{checkpoint.rstrip('/')}/windows"))

        def send(batch: DataFrame, number: int) -> None:
            done = steps.step(numbered(batch, number, below.by_column)[0], number)
            sink.send(_rest(query, inner, StreamFrame(done, steps.out_fields)).to_df(), number)

    writer = df.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(send)
    return (writer.trigger(availableNow=True) if once else writer).start()


def numbered(batch: DataFrame, number: int, own: bool) -> tuple[DataFrame, tuple[int, int] | None]:
    """The batch with an arrival order that continues from earlier batches, where no column of the source gives it: files go by
    time, path and place, other sources by the order of the batch's partitions. Also the least and the greatest order, if known."""
    if own:
        return batch, None
    kind, seq, base = batch.schema[SEQ].dataType, F.col(SEQ), number << 44
    if places.is_place(kind):
        file, row = F.struct(seq["time"], seq["path"]), seq["row"]
    elif isinstance(kind, T.StringType):  # a place that went through the state store
        file, row = places.file_of(seq), places.row_of(seq)
    else:
        return batch.withColumn(SEQ, F.lit(base) + F.monotonically_increasing_id()), None
    made, rows = places.numbered(batch, file, row, "__at")
    return made.withColumn(SEQ, F.lit(base) + F.col("__at")).drop("__at"), (base, base + rows - 1) if rows else None


def finish(query: Select, sources: Callable[[str, str | None], StreamFrame], sink: Sink, checkpoint: str) -> None:
    """Emits the windows that a stopped streaming aggregate has left open, as at the end of a bounded input."""
    inner = aggregate_of(query)
    if inner is None:
        return
    below = plan(Select([E.Wildcard()], inner.source, inner.where), sources)
    spark = below._df.sparkSession
    steps = WindowedBatches(below, inner, WindowState(spark, f"{checkpoint.rstrip('/')}/windows"))
    last = steps.state.last()
    if last < 0:
        return
    none = spark.createDataFrame([], below._df.schema)
    none = none if below.by_column else none.withColumn(SEQ, F.lit(None).cast("long"))
    done = steps.step(none, last + 1, final=True)
    sink.send(_rest(query, inner, StreamFrame(done, steps.out_fields)).to_df(), last + 1)


def native_aggregate(df: DataFrame, time: str, window: Window, keys: Sequence[str], aggregates: Sequence, delay: str = "0 seconds") -> DataFrame:
    """Windowed aggregation with Spark's own watermark, for append output: a fixed or sliding window only."""
    length, step = window.length, window.interval or window.length
    marked = df.withColumn(TIME, F.col(time).cast("timestamp")).withWatermark(f"`{TIME}`", delay)
    grouped = marked.groupBy(F.window(F.col(TIME), f"{length} milliseconds", f"{step} milliseconds").alias("__w"), *keys).agg(*aggregates)
    start = F.timestamp_millis(F.unix_millis("__w.start") + (length - step))
    return grouped.withColumn(TIME, start).drop("__w")
