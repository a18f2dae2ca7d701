"""The DataFrame-style DSL: one linear pipeline source -> filter -> projection or windowed aggregate -> filter.

Each step builds Spark DataFrame operations at once, so Catalyst sees plain relational plans. The arrival order (``seq``) and
the keys that part the rows into series travel as hidden columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import expr as E
from ..errors import PlanError
from ..plans.compile import TIME, Compiler, Field, Series, Typed, find, fields_of, is_stateful, quoted
from ..plans.prefix import Carry
from ..sources import order as places
from .window import Window, drop_late, with_start

SEQ = "__seq"
START = "__start"


def _instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps and dates as instants, so that all time functions take them."""
    odd = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType | T.DateType)]
    return df.withColumns({n: quoted(n).cast("timestamp") for n in odd}) if odd else df


def _distinct(names: Sequence[str]) -> None:
    seen = set()
    for n in names:
        if n.lower() in seen:
            raise PlanError(f"duplicate column: {n}")
        seen.add(n.lower())


class StreamFrame:
    """A pipeline over a bounded or streaming DataFrame."""

    def __init__(self, df: DataFrame, fields: Sequence[Field], keys: Sequence[str] = (), in_order: bool = False, ordered: bool = True, by_column: bool = True, carry: Carry | None = None):
        self._df, self.fields, self._keys, self._in_order = df, list(fields), tuple(keys), in_order
        self._ordered, self.by_column = ordered, by_column  # whether there is an arrival order, and whether a column gives it
        self._carry = carry  # of a batch of a stream: what the batches before left

    @staticmethod
    def source(df: DataFrame, time: E.Expr | None = None, seq: str | None = None, partition_by: Sequence[str] = (), qualifier: str | None = None, in_order: bool = False) -> "StreamFrame":
        """A source with the hidden column ``@time``: the time expression on the raw row, the wall clock without one.

        seq: the column that gives the arrival order. Without one files that were read with their places go by modification time,
        path and place in the file, other bounded tables by the order of their partitions; other streams have no order, so
        stateful functions refuse them. partition_by: columns that
        part the rows into series for running functions; without any there is one series. in_order: promises that the event
        time never falls along the arrival order, so no row is late; it is known without a promise where seq is the time.
        """
        df = _instants(df)
        fields = [f for f in fields_of(df, qualifier) if f.name != places.PLACE]
        _distinct([f.name for f in fields])
        if time is None:
            at = F.current_timestamp()
        else:
            t = Compiler(fields, "scalar").compile(time)
            if t.type not in ("timestamp", "int64"):
                raise PlanError(f"the time expression must be a timestamp, not {t.type}")
            at = F.timestamp_millis(t.column) if t.type == "int64" else t.column
        ordered = True
        if seq:
            order = quoted(find(fields, seq, None).source)
        elif places.PLACE in df.columns:
            order = F.col(places.PLACE)
        elif df.isStreaming:
            order, ordered = F.lit(None).cast("long"), False
        else:
            order = F.monotonically_increasing_id()
        keys = {f"__key{i}": quoted(find(fields, k, None).source) for i, k in enumerate(partition_by)}
        out = df.withColumns({TIME: at, SEQ: order, **keys}).drop(places.PLACE)
        same = isinstance(time, E.Column) and seq is not None and time.name.lower() == seq.lower()
        return StreamFrame(out, [*fields, Field(TIME, "timestamp", qualifier)], tuple(keys), in_order or same, ordered, seq is not None)

    def renamed(self, qualifier: str | None) -> "StreamFrame":
        """The same rows under another qualifier, as a sub-query's alias gives them."""
        return StreamFrame(self._df, [Field(f.name, f.type, qualifier, f.source) for f in self.fields], self._keys, self._in_order, self._ordered, self.by_column, self._carry)

    # -- operators ---------------------------------------------------------------------------------------------------

    def _series(self) -> Series:
        return Series(SEQ, [F.col(k) for k in self._keys])

    def _expand(self, exprs) -> list[E.Expr]:
        out = []
        for e in map(E.as_expr, exprs):
            if isinstance(e, E.Wildcard):
                own = [f for f in self.fields if e.qualifier is None or (f.qualifier or "").lower() == e.qualifier.lower()]
                if e.qualifier is not None and not own:
                    raise PlanError(f"no such qualifier: {e.qualifier}")
                out += [E.Column(f.name, f.qualifier) for f in own]
            else:
                out.append(e)
        if not out:
            raise PlanError("an empty select list")
        return out

    def select(self, *exprs) -> "StreamFrame":
        """Projection. Stateful functions run along the series; ``@time`` goes unless it is selected."""
        items = self._expand(exprs)
        names = [e.output_name() for e in items]
        _distinct(names)
        c = Compiler(self.fields, "running", self._series(), self._df.isStreaming, self._carry)
        typed = [c.compile(e) for e in items]
        if c.needs_order:
            self._need_order()
        df = c.apply(self._df)
        out = df.select(*[t.column.alias(n) for t, n in zip(typed, names, strict=True)], SEQ, *self._keys)
        qualifiers = [find(self.fields, e.name, e.qualifier).qualifier if isinstance(e, E.Column) else None for e in items]
        kept = self._in_order and all(isinstance(e, E.Column) for e, n in zip(items, names, strict=True) if n.lower() == TIME)
        return StreamFrame(out, [Field(n, t.type, q) for n, t, q in zip(names, typed, qualifiers, strict=True)], self._keys, kept, self._ordered, self.by_column, self._carry)

    def filter(self, predicate) -> "StreamFrame":
        """Rows for which the predicate is true; top-level conjuncts stay apart so that they can be pushed down."""
        df = self._df
        if is_stateful(predicate):
            c = Compiler(self.fields, "running", self._series(), self._df.isStreaming, self._carry)
            t = self._boolean(c.compile(predicate))
            self._need_order()
            df = c.apply(df).where(t.column).select(*df.columns)
        else:
            for part in _conjuncts(predicate):
                df = df.where(self._boolean(Compiler(self.fields, "scalar").compile(part)).column)
        return StreamFrame(df, self.fields, self._keys, self._in_order, self._ordered, self.by_column, self._carry)

    def _need_order(self) -> None:
        if not self._ordered:
            raise PlanError("stateful functions need an arrival order: name a column of the stream that gives it")

    @staticmethod
    def _boolean(t: Typed) -> Typed:
        if t.type not in ("boolean", "null"):
            raise PlanError(f"a filter needs a boolean, not {t.type}")
        return t

    def aggregate(self, keys: Sequence, items: Sequence, window: Window, watermark=None) -> "StreamFrame":
        """Windowed aggregate. Output: the items, then ``@time``, the window's start. Keys are not added to the output; an
        item that is no aggregate has its value at the group's last row. Late rows are dropped (see window.drop_late)."""
        time_field = find(self.fields, TIME, None)
        if time_field.type != "timestamp":
            raise PlanError("@time must be a timestamp")
        time = quoted(time_field.source)
        scalar = Compiler(self.fields, "scalar")
        mark = scalar.compile(E.as_expr(watermark)) if watermark is not None else None
        if mark is not None and mark.type != "timestamp":
            raise PlanError("a watermark must be a timestamp")
        df = self._df
        if df.isStreaming:
            raise PlanError("a streaming aggregate is run by rillstone.streaming")
        if self._in_order and (watermark is None or _is_delay(watermark)):
            df = df.where(time.isNotNull())
        else:
            df = drop_late(df, time, mark and mark.column, SEQ)
        made = [scalar.compile(E.as_expr(k)) for k in keys]
        key_columns = {f"__group{i}": k.column for i, k in enumerate(made)}
        df = with_start(df.withColumns(key_columns) if key_columns else df, time, window, START)
        names = [E.as_expr(e).output_name() for e in items]
        _distinct([*names, TIME])
        groups = [START, *key_columns]
        c = Compiler(self.fields, "grouped", Series(SEQ, [F.col(g) for g in groups]))
        c.group_keys = {t: Typed(F.col(f"__group{i}"), k.type) for i, (e, k) in enumerate(zip(keys, made, strict=True)) if (t := scalar.text_of(E.as_expr(e)))}
        typed = [c.compile(E.as_expr(e)) for e in items]
        df = c.apply(df)
        grouped = df.groupBy(*groups).agg(*c.aggregates.values(), F.max(SEQ).alias("__last"))
        out = grouped.select(*[t.column.alias(n) for t, n in zip(typed, names, strict=True)], F.col(START).alias(TIME), F.struct(F.col(START), F.col("__last")).alias(SEQ))
        return StreamFrame(out, [*[Field(n, t.type) for n, t in zip(names, typed, strict=True)], Field(TIME, "timestamp")], in_order=True)

    # -- results -----------------------------------------------------------------------------------------------------

    @property
    def schema(self) -> T.StructType:
        return self.to_df().schema

    def to_df(self) -> DataFrame:
        """The visible columns."""
        return self._df.select(*[quoted(f.source).alias(f.name) for f in self.fields])

    def observed(self, name: str = "rows") -> tuple[DataFrame, object]:
        """The result with an observation that counts its rows while it runs."""
        from pyspark.sql import Observation

        seen = Observation(name)
        return self.to_df().observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _is_delay(e: E.Expr) -> bool:
    """Whether a watermark is the event time less a constant: it rises with the time and never passes it."""
    return isinstance(e, E.Call) and e.namespace is None and e.name.lower() == "timestamp_sub" and len(e.args) == 2 and isinstance(e.args[0], E.Column) and e.args[0].name.lower() == TIME and isinstance(e.args[1], E.Literal) and isinstance(e.args[1].value, int) and e.args[1].value >= 0


def _conjuncts(e: E.Expr) -> list[E.Expr]:
    if isinstance(e, E.Binary) and e.op == "and":
        return [*_conjuncts(e.left), *_conjuncts(e.right)]
    return [e]
