"""Running values over a whole stream without a task that sees the whole stream.

The arrival order is cut into buckets of equal width. Each bucket is aggregated; a window over the buckets (one row each, so few
that the result can be broadcast) tells what came before each of them, and a window inside the bucket gives the rest. Both parts
are combined for each row. Texts are cut by their first seven bytes. Other orders than whole numbers, decimals, times, texts and
structs that begin with one, and orders that hold one value only, take a plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..sources import order as places

#: Least and most buckets that an order is cut into, and the rows aimed at in each: a table of MOST_BUCKETS rows is a few MB.
BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 256, 200_000, 500_000
BUCKET = "__bucket"
#: The bucket of what earlier batches of a stream left; rows without an order are in bucket -1.
EARLIER = -2


@dataclass
class Running:
    """A running aggregate: output name, function, argument, and for max and min whether NaN is ignored."""

    name: str
    function: str
    arg: Column
    floats: bool = False


def _coarse(c: Column, kind: T.DataType) -> Column | None:
    """A bigint that never falls as the order rises."""
    if isinstance(kind, T.LongType | T.IntegerType | T.ShortType | T.ByteType):
        return c.cast("long")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.DecimalType) and kind.precision - kind.scale <= 18:
        return F.floor(c).cast("long")
    if isinstance(kind, T.StringType):  # texts are ordered by their bytes; the first seven fit a bigint
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    if isinstance(kind, T.StructType) and len(kind):
        return _coarse(c[kind[0].name], kind[0].dataType)
    return None


def bucketed(df: DataFrame, seq: str, buckets: int = BUCKETS, span: tuple[int, int] | None = None) -> DataFrame | None:
    """df with the bucket of each row; None if the order can't be cut. span: the least and the greatest order, where they are known."""
    kind = df.schema[seq].dataType
    if places.is_place(kind):  # rows of files are numbered, so buckets are even
        numbers, rows = places.numbered(df, F.struct(F.col(seq)["time"], F.col(seq)["path"]), F.col(seq)["row"], BUCKET)
        width = rows // min(MOST_BUCKETS, max(buckets, rows // BUCKET_ROWS)) + 1
        return numbers.withColumn(BUCKET, F.floor(F.col(BUCKET) / F.lit(width)).cast("int"))
    coarse = _coarse(F.col(seq), kind)
    if coarse is None:
        return None
    low, high, rows = (*span, span[1] - span[0] + 1) if span else df.agg(F.min(coarse), F.max(coarse), F.count(F.lit(1))).first()
    if low is None or high == low:
        return None
    width = (high - low) // min(MOST_BUCKETS, max(buckets, rows // BUCKET_ROWS)) + 1
    return df.withColumn(BUCKET, F.coalesce(F.floor((coarse.cast("decimal(20,0)") - F.lit(low)) / F.lit(width)), F.lit(-1)).cast("int"))


def _parts(r: Running, seq: Column, x: Column) -> dict[str, tuple[Column, Column | None, Column]]:
    """For each part of a running aggregate: its aggregate in a bucket, its window function over buckets, and in a bucket."""
    if r.function in ("sum", "count", "avg"):
        total = (F.sum(x), F.sum, F.sum(x))
        n = (F.count(x), F.sum, F.count(x))
        return {"sum": {"s": total}, "count": {"n": n}, "avg": {"s": total, "n": n}}[r.function]
    if r.function in ("max", "min"):
        x = F.when(~F.isnan(x), x) if r.floats else x
        f = F.max if r.function == "max" else F.min
        return {"m": (f(x), f, f(x))}
    if r.function == "first":
        return {"v": (F.min_by(x, F.when(x.isNotNull(), seq)), lambda c: F.first(c, ignorenulls=True), F.first(x, ignorenulls=True))}
    return {"v": (F.max_by(x, F.when(x.isNotNull(), seq)), lambda c: F.last(c, ignorenulls=True), F.last(x, ignorenulls=True))}


def _combined(r: Running, before: dict[str, Column], own: dict[str, Column]) -> Column:
    if r.function in ("sum", "count", "avg"):
        add = {k: F.coalesce(before[k], F.lit(0)) + F.coalesce(own[k], F.lit(0)) for k in own}
        if r.function == "avg":
            return F.when(add["n"] > 0, add["s"] / F.when(add["n"] > 0, add["n"])).otherwise(F.lit(float("nan")))
        return add["s"].cast("double") if r.function == "sum" else add["n"]
    if r.function in ("max", "min"):
        return (F.greatest if r.function == "max" else F.least)(before["m"], own["m"])
    return F.coalesce(before["v"], own["v"]) if r.function == "first" else F.coalesce(own["v"], before["v"])


def _total(r: Running, c: Column) -> Column:
    """A part over all buckets."""
    if r.function in ("first", "last"):
        return (F.min_by if r.function == "first" else F.max_by)(c, F.when(c.isNotNull(), F.col(BUCKET)))
    return {"max": F.max, "min": F.min}.get(r.function, F.sum)(c)


class Carry:
    """What the running aggregates of a stream hold after each of its batches, in a folder: one row for each call of ``running``.
    Folders are named by batch, so a repeated batch reads what it read before. span: the least and the greatest order of the batch's
    rows, where they were numbered."""

    def __init__(self, spark: SparkSession, path: str, batch: int, span: tuple[int, int] | None = None):
        self.spark, self.path, self.batch, self.span, self._n = spark, path.rstrip("/"), batch, span, 0

    def through(self, tops: DataFrame, totals: list[Column]) -> DataFrame:
        """The buckets' parts after those of the batches before; what this batch leaves is written."""
        at, n = f"{self.path}/batch={self.batch}", self._n
        self._n += 1
        if self.batch:
            tops = tops.unionByName(self.spark.read.schema(tops.schema).parquet(f"{self.path}/batch={self.batch - 1}/left{n}"))
        tops.write.mode("overwrite").parquet(f"{at}/tops{n}")
        tops = self.spark.read.schema(tops.schema).parquet(f"{at}/tops{n}")
        tops.agg(*totals).withColumn(BUCKET, F.lit(EARLIER)).write.mode("overwrite").parquet(f"{at}/left{n}")
        storage.remove(self.spark, f"{self.path}/batch={self.batch - 3}")
        return tops


def running(df: DataFrame, seq: str, calls: list[Running], buckets: int = BUCKETS, carry: Carry | None = None) -> DataFrame:
    """df with the running aggregates over all rows up to each one in order of seq. carry: df is a batch of a stream, whose values
    go on from those of the batches before."""
    args = {f"__x_{r.name}": r.arg for r in calls}
    made = bucketed(df, seq, buckets, carry.span if carry is not None else None)
    order = F.col(seq)
    upto = (Window.unboundedPreceding, Window.currentRow)
    parts = [_parts(r, order, F.col(f"__x_{r.name}")) for r in calls]
    if made is None and carry is not None:
        made = df.withColumn(BUCKET, F.lit(0))
    if made is None:
        work = df.withColumns(args)
        w = Window.orderBy(order).rowsBetween(*upto)
        nothing = [{k: F.lit(None).cast("double") if k == "s" else F.lit(None) for k in p} for p in parts]
        values = {r.name: _combined(r, b, {k: p[2].over(w) for k, p in own.items()}) for r, b, own in zip(calls, nothing, parts, strict=True)}
        return work.withColumns(values).drop(*args)
    work = made.withColumns(args)
    names = [{k: f"__{k}_{r.name}" for k in p} for r, p in zip(calls, parts, strict=True)]
    tops = work.groupBy(BUCKET).agg(*[p[0].alias(n[k]) for n, own in zip(names, parts, strict=True) for k, p in own.items()])
    if carry is not None:
        tops = carry.through(tops, [_total(r, F.col(c)).alias(c) for r, n in zip(calls, names, strict=True) for c in n.values()])
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(BUCKET, *[p[1](F.col(n[k])).over(earlier).alias(n[k]) for n, own in zip(names, parts, strict=True) for k, p in own.items()])
    w = Window.partitionBy(BUCKET).orderBy(order).rowsBetween(*upto)
    joined = work.join(F.broadcast(before), BUCKET, "left")
    values = {r.name: _combined(r, {k: F.col(c) for k, c in n.items()}, {k: p[2].over(w) for k, p in own.items()}) for r, n, own in zip(calls, names, parts, strict=True)}
    return joined.withColumns(values).drop(BUCKET, *args, *[c for n in names for c in n.values()])
