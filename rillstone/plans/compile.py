"""Expressions to Spark columns, in three contexts.

* SCALAR: no stateful call is allowed.
* RUNNING: stateful calls run along the series (one value for each row).
* GROUPED: aggregates are grouped aggregations; anything else is its value at the last row of the group.

A stateful call becomes a helper column. Helper columns have levels, as Spark can't nest window functions: a call whose
arguments hold stateful calls is computed one level after them. Recurrences are folded level by level too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import expr as E
from ..errors import PlanError
from ..functions.registry import Function, lookup
from ..functions.series_ref import SeriesWindow
from ..functions.stepping import step_of, zeros_for
from ..sources import order as places
from ..types import FLOATS, INTS, NUMERIC, SPARK, literal_type, name_of
from .affine import is_affine, starts
from .prefix import BUCKET, Carry, Running, bucketed, running

TIME = "@time"
INDEX, BLOCK = "__rill_index", "__rill_block"
#: Aggregates that can be merged from parts.
MERGED = ("avg", "sum", "count", "max", "min", "first", "last")
#: Rows in a block of a whole stream.
BLOCK_ROWS = 200_000


@dataclass
class Field:
    """A column in scope: its name, type, optional qualifier, and the DataFrame column that holds it."""

    name: str
    type: str
    qualifier: str | None = None
    source: str = ""

    def __post_init__(self):
        self.source = self.source or self.name


def fields_of(df: DataFrame, qualifier: str | None = None) -> list[Field]:
    return [Field(f.name, name_of(f.dataType), qualifier) for f in df.schema]


def find(fields: Sequence[Field], name: str, qualifier: str | None) -> Field:
    """Names are case-insensitive; the first match wins."""
    for f in fields:
        if f.name.lower() == name.lower() and (qualifier is None or (f.qualifier or "").lower() == qualifier.lower()):
            return f
    raise PlanError(f"not such column: {f'{qualifier}.' if qualifier else ''}{name}")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Typed:
    column: Column
    type: str
    level: int = 0  # of the helper columns it reads
    literal: object = None
    is_literal: bool = False


@dataclass
class Series:
    """How rows are ordered, and the keys that part them into series."""

    seq: str
    keys: list[Column] = field(default_factory=list)

    def window(self):
        spec = Window.partitionBy(*self.keys) if self.keys else Window.partitionBy()
        return spec.orderBy(quoted(self.seq))


class WholeSeries(SeriesWindow):
    """One series of all rows: windows look back inside blocks of rows, aggregates since the start go by bucket prefixes."""

    def __init__(self, compiler: "Compiler", level: int):
        super().__init__(Window.partitionBy(BLOCK).orderBy(INDEX))
        self.compiler, self.level = compiler, level

    def back(self, n: int) -> WindowSpec:
        self.compiler.lookback[self.level] = max(n, self.compiler.lookback.get(self.level, 0))
        return self.spec

    def upto(self, function: str, x: Column) -> Column:
        name = self.compiler._name()
        self.compiler.whole.setdefault(self.level, []).append(Running(name, function, x))
        return F.col(name)


def in_blocks(df: DataFrame, helpers: dict[str, Column], lookback: int) -> DataFrame:
    """Adds windowed columns of a whole stream: rows are cut into blocks of equal count by their number, the last ``lookback``
    rows of each block are lent to the next one, and only own rows are kept."""
    rows = max(BLOCK_ROWS, 4 * lookback)
    own = F.floor((F.col(INDEX) - 1) / rows)
    lent = F.pmod(F.col(INDEX) - 1, F.lit(rows)) >= rows - lookback
    places = F.when(lent, F.array(own, own + 1)).otherwise(F.array(own)) if lookback else F.array(own)
    work = df.withColumn(BLOCK, F.explode(places)).withColumns(helpers)
    return work.where(F.col(BLOCK) == own).drop(BLOCK)


def cast(t: Typed, to: str) -> Column:
    if t.type == to or t.type == "other":
        return t.column
    return t.column.cast(SPARK[to])


def is_stateful(e: E.Expr) -> bool:
    if isinstance(e, E.Call) and lookup(e.namespace, e.name).kind != "scalar":
        return True
    return any(map(is_stateful, E.children(e)))


@dataclass
class Fold:
    """A stateful call that is stepped from row to row."""

    name: str
    namespace: str | None
    function: str
    zeros: tuple
    args: list[Column]
    type: str

    def step(self, state, values):
        return step_of(self.namespace, self.function, self.zeros, state, *values)


class Compiler:
    """Compiles the expressions of one operator; apply() adds the helper columns they need."""

    def __init__(self, fields: Sequence[Field], context: str, series: Series | None = None, streaming: bool = False, carry: Carry | None = None):
        self.fields, self.context, self.series, self.streaming, self.carry = list(fields), context, series, streaming, carry
        self.helpers: dict[int, dict[str, Column]] = {}
        self.folds: dict[int, list[Fold]] = {}
        self.whole: dict[int, list[Running]] = {}  # aggregates over a whole stream
        self.lookback: dict[int, int] = {}  # rows that the helpers of a level look back, in a whole stream
        self.aggregates: dict[str, Column] = {}
        self.parts: dict[str, tuple[str, Column, str] | None] = {}  # by aggregate: function, argument, type; None if it needs rows
        self.needs_index = False
        self.group_keys: dict[str, Typed] = {}  # by the key's text: items that are keys need no aggregate
        self._n = 0

    @property
    def needs_order(self) -> bool:
        return bool(self.helpers or self.folds or self.whole)

    def _name(self) -> str:
        self._n += 1
        return f"__rill{self._n}"

    # -- expressions -------------------------------------------------------------------------------------------------

    def compile(self, e: E.Expr) -> Typed:
        if isinstance(e, E.Alias):
            return self.compile(e.child)
        if self.group_keys and (key := self.group_keys.get(self.text_of(e))):
            return key
        if isinstance(e, E.Literal):
            kind = literal_type(e.value)
            return Typed(F.lit(e.value).cast(SPARK[kind]), kind, literal=e.value, is_literal=True)
        if isinstance(e, E.Column):
            f = find(self.fields, e.name, e.qualifier)
            c = quoted(f.source)
            if self.context == "grouped":
                return Typed(self._aggregate(F.max_by(c, quoted(self.series.seq)), ("row", c, f.type)), f.type)
            return Typed(c, f.type)
        if isinstance(e, E.Wildcard):
            raise PlanError("a wildcard stands only at the top of a select list")
        if isinstance(e, E.Unary):
            return self._unary(e)
        if isinstance(e, E.Binary):
            return self._binary(e)
        if isinstance(e, E.Call):
            return self._call(e)
        raise PlanError(f"unknown expression: {e!r}")

    def text_of(self, e: E.Expr) -> str | None:
        """A column's source, which tells it whatever its case or qualifier; None for other expressions."""
        return find(self.fields, e.name, e.qualifier).source if isinstance(e, E.Column) else None

    def _unary(self, e: E.Unary) -> Typed:
        x = self.compile(e.child)
        if e.op == "-":
            if x.type not in NUMERIC:
                raise PlanError(f"can't negate {x.type}")
            if x.is_literal:
                return Typed(F.lit(-x.literal).cast(SPARK[literal_type(-x.literal)]), literal_type(-x.literal), literal=-x.literal, is_literal=True)
            return Typed(-x.column, x.type, x.level)
        if x.type not in ("boolean", "null"):
            raise PlanError(f"not needs a boolean, not {x.type}")
        return Typed(~x.column, "boolean", x.level)

    def _binary(self, e: E.Binary) -> Typed:
        a, b = self.compile(e.left), self.compile(e.right)
        level = max(a.level, b.level)
        op = e.op
        if op in ("and", "or"):
            if not {a.type, b.type} <= {"boolean", "null"}:
                raise PlanError(f"{op} needs booleans, not {a.type} and {b.type}")
            both = a.column & b.column if op == "and" else a.column | b.column
            return Typed(F.when(a.column.isNotNull() & b.column.isNotNull(), both), "boolean", level)
        if op in ("+", "-", "*", "/", "%"):
            if a.type not in NUMERIC or b.type not in NUMERIC:
                raise PlanError(f"{op} needs numbers, not {a.type} and {b.type}")
            if a.type in INTS and b.type in INTS:
                x, y = cast(a, "int64"), cast(b, "int64")
                if op == "/":
                    return Typed(F.call_function("div", x, y), "int64", level)
                return Typed({"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op], "int64", level)
            if op == "%":
                raise PlanError("% needs integers")
            x, y = cast(a, "float64"), cast(b, "float64")
            if op == "/":
                return Typed(_float_div(x, y), "float64", level)
            return Typed(x + y if op == "+" else x - y if op == "-" else x * y, "float64", level)
        x, y = a.column, b.column
        if a.type in NUMERIC and b.type in NUMERIC:
            wide = "float64" if {a.type, b.type} & set(FLOATS) else "int64"
            x, y = cast(a, wide), cast(b, wide)
        elif a.type != b.type and "null" not in (a.type, b.type):
            raise PlanError(f"can't compare {a.type} with {b.type}")
        return Typed({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "boolean", level)

    def _call(self, e: E.Call) -> Typed:
        f = lookup(e.namespace, e.name)
        if f.kind == "scalar":
            args = [self.compile(a) for a in e.args]
            types = f.bind(tuple(a.type for a in args))
            cols = [a.literal if i in f.constants and self._constant(f, a) else cast(a, t) for i, (a, t) in enumerate(zip(args, types, strict=True))]
            return Typed(f.build(types, *cols), f.return_type(types), max((a.level for a in args), default=0))
        if self.context == "scalar":
            raise PlanError(f"{f.name} needs an ordered series")
        if self.context == "grouped":
            inner = self._inner()
            if f.kind == "aggregate":
                args = [inner.compile(a) for a in e.args]
                types = f.bind(tuple(a.type for a in args))
                x = cast(args[0], types[0])
                got = f.grouped(types, x, quoted(self.series.seq))
                part = (f.name, x, types[0]) if f.name in MERGED and f.namespace is None and not inner.needs_order else None
                self._take(inner)
                return Typed(self._aggregate(got, part), f.return_type(types))
            x = inner.compile(e)
            self._take(inner)
            return Typed(self._aggregate(F.max_by(x.column, quoted(self.series.seq))), x.type)
        args = [self.compile(a) for a in e.args]
        types = f.bind(tuple(a.type for a in args))
        level = max((a.level for a in args), default=0) + 1
        name = self._name()
        if f.kind == "recurrence" or self.streaming:
            self.folds.setdefault(level, []).append(Fold(name, f.namespace, f.name, zeros_for(f, types), [cast(a, t) for a, t in zip(args, types, strict=True)], f.return_type(types)))
        else:
            w = self.series.window()
            if f.kind == "aggregate" and not self.series.keys:
                arg = cast(args[0], types[0])
                self.whole.setdefault(level, []).append(Running(name, f.name, arg, types[0].startswith("float")))
                return Typed(F.col(name), f.return_type(types), level)
            if f.kind == "aggregate":
                made = f.running(types, cast(args[0], types[0]), w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            else:
                s = SeriesWindow(w) if self.series.keys else WholeSeries(self, level)
                self.needs_index = True
                made = f.running(s, *[int(a.literal) if i in f.constants and self._constant(f, a) else cast(a, t) for i, (a, t) in enumerate(zip(args, types, strict=True))])
            self.helpers.setdefault(level, {})[name] = made
        return Typed(F.col(name), f.return_type(types), level)

    def _constant(self, f: Function, a: Typed) -> bool:
        if not a.is_literal:
            raise PlanError(f"{f.name}: this argument must be a constant")
        return True

    # -- grouped context ---------------------------------------------------------------------------------------------

    def _inner(self) -> "Compiler":
        inner = Compiler(self.fields, "running", self.series)
        inner._n = self._n
        return inner

    def _take(self, inner: "Compiler") -> None:
        self._n = inner._n
        self.needs_index |= inner.needs_index
        for level, cols in inner.helpers.items():
            self.helpers.setdefault(level, {}).update(cols)
        for level, folds in inner.folds.items():
            self.folds.setdefault(level, []).extend(folds)
        for level, rows in inner.lookback.items():
            self.lookback[level] = max(rows, self.lookback.get(level, 0))
        for level, whole in inner.whole.items():
            self.whole.setdefault(level, []).extend(whole)

    def _aggregate(self, c: Column, part: tuple | None = None) -> Column:
        name = self._name()
        self.parts[name] = part
        self.aggregates[name] = c.alias(name)
        return F.col(name)

    # -- helper columns ----------------------------------------------------------------------------------------------

    def _numbered(self, df: DataFrame) -> DataFrame:
        if self.series.keys:
            return df.withColumn(INDEX, F.row_number().over(self.series.window()).cast("long"))
        return running(df, self.series.seq, [Running(INDEX, "count", F.lit(1))])

    def apply(self, df: DataFrame) -> DataFrame:
        """df with the helper columns."""
        if self.needs_index:
            df = self._numbered(df)
        for level in sorted({*self.helpers, *self.folds, *self.whole}):
            if level in self.whole:
                df = running(df, self.series.seq, self.whole[level], carry=self.carry)
            if level in self.helpers:
                df = df.withColumns(self.helpers[level]) if self.series.keys else in_blocks(df, self.helpers[level], self.lookback.get(level, 0))
            if level in self.folds:
                df = (fold_stream if self.streaming else fold)(df, self.series, self.folds[level])
        return df


def _float_div(x: Column, y: Column) -> Column:
    """IEEE division: by zero gives an infinity or NaN instead of an error."""
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x.isNotNull(), F.signum(x) * F.lit(float("inf")))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def _fold_columns(df: DataFrame, series: Series, calls: list[Fold]) -> tuple[DataFrame, list[str], list[list[str]]]:
    """df with the series' keys and the calls' arguments as columns, and their names."""
    keys = {f"__rill_key{i}": c for i, c in enumerate(series.keys)}
    args = [[f"{c.name}_{i}" for i in range(len(c.args))] for c in calls]
    made = {n: a for names, c in zip(args, calls, strict=True) for n, a in zip(names, c.args, strict=True)}
    return df.withColumns({**keys, **made}), list(keys), args


def fold(df: DataFrame, series: Series, calls: list[Fold]) -> DataFrame:
    """Adds the calls' values: rows of a series come to one task in order, and each call's state is carried from row to row,
    also across batches, so memory does not grow with the series. Without keys, recurrences that are affine maps go by buckets
    of the order, each of which starts from the state that the maps of the buckets before it lead to."""
    maps, rest = ([], calls) if series.keys else ([c for c in calls if is_affine(c)], [c for c in calls if not is_affine(c)])
    if maps and (made := bucketed(df, series.seq)) is not None:
        work, _, args = _fold_columns(made, series, maps)
        begin = starts(work, quoted(series.seq), maps, args)
        work = work.join(F.broadcast(begin), BUCKET, "left").repartition(BUCKET).sortWithinPartitions(BUCKET, quoted(series.seq))
        df = _stepped(work, [BUCKET], args, maps, begin.columns[1:]).drop(*begin.columns)
        if not rest:
            return df
        calls = rest
    work, keys, args = _fold_columns(df, series, calls)
    work = work.repartition(*keys) if keys else work.coalesce(1)
    return _stepped(work.sortWithinPartitions(*keys, quoted(series.seq)), keys, args, calls)


def _stepped(work: DataFrame, keys: list[str], args: list[list[str]], calls: list[Fold], begin: list[str] = ()) -> DataFrame:
    """work, sorted in partitions, with the calls' values. begin: for each call the column of the state before a key's first row."""
    out = T.StructType([*work.schema, *[T.StructField(c.name, SPARK[c.type]) for c in calls]])
    steppers = [Fold(c.name, c.namespace, c.function, c.zeros, [], c.type) for c in calls]
    types = to_arrow_types(steppers)

    def run(batches):
        import pyarrow as pa

        at, states = None, [None] * len(steppers)
        for batch in batches:
            # a NaN key is one key, though no NaN equals another
            owners = [tuple("NaN" if x != x else x for x in k) for k in zip(*[batch.column(k).to_pylist() for k in keys], strict=True)] if keys else [()] * batch.num_rows
            rows = [list(zip(*[batch.column(a).to_pylist() for a in names], strict=True)) for names in args]
            first = [batch.column(b) for b in begin]
            made = [[] for _ in steppers]
            for i, owner in enumerate(owners):
                if owner != at:
                    at, states = owner, [b[i].as_py() for b in first] or [None] * len(steppers)
                for j, c in enumerate(steppers):
                    states[j], y = c.step(states[j], rows[j][i])
                    made[j].append(y)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(m, t) for m, t in zip(made, types, strict=True)]], [*batch.schema.names, *[c.name for c in steppers]])

    return work.mapInArrow(run, out).drop(*keys, *[n for names in args for n in names])


def to_arrow_types(calls: list[Fold]) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(SPARK[c.type], timezone="UTC") if c.type == "timestamp" else to_arrow_type(SPARK[c.type]) for c in calls]


def fold_stream(df: DataFrame, series: Series, calls: list[Fold]) -> DataFrame:
    """The same on a stream: the states of a series are kept in Spark's state store from batch to batch."""
    if places.is_place(df.schema[series.seq].dataType):  # pandas sorts texts, not structs
        df = df.withColumn(series.seq, places.as_text(F.col(series.seq)))
    work, keys, args = _fold_columns(df, series, calls)
    if not keys:
        work, keys = work.withColumn("__rill_key0", F.lit(0)), ["__rill_key0"]
    out = T.StructType([*work.schema, *[T.StructField(c.name, SPARK[c.type]) for c in calls]])
    steppers = [Fold(c.name, c.namespace, c.function, c.zeros, [], c.type) for c in calls]
    seq, names = series.seq, [f.name for f in out]

    def run(key, frames, state):
        import pickle

        import pandas as pd

        states = pickle.loads(bytes(state.get[0])) if state.exists else [None] * len(steppers)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(seq, kind="stable", ignore_index=True)
        for c, own, j in zip(steppers, args, range(len(steppers)), strict=True):
            made = []
            for values in rows[own].itertuples(index=False, name=None):
                states[j], y = c.step(states[j], [None if v is pd.NaT or v is pd.NA or v is None else v for v in values])
                made.append(y)
            rows[c.name] = pd.Series(made, dtype=object)
        state.update((pickle.dumps(states),))
        yield rows[names]

    stepped = work.groupBy(*keys).applyInPandasWithState(run, out, "state binary", "append", "NoTimeout")
    return stepped.drop(*keys, *[n for own in args for n in own])
