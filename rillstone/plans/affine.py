"""The states with which the buckets of a whole stream begin, for recurrences that are affine maps of their state.

Each bucket's rows are composed to one map, in tasks that hold one row at a time. The maps of all buckets (prefix.MOST_BUCKETS rows
at most) are then applied in order by one task. A factor that would underflow stays at the smallest number, so that an infinite
state stays infinite as it does from row to row. Recurrences that grow (``f.ema`` of a negative n) may reach infinity earlier.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..functions.series_ref import MAPS
from .prefix import BUCKET

#: Of a bucket and a call: the first row's value and map, and the map of all other rows.
PARTS = ("x", "a", "b", "rest_a", "rest_b")
TINY = math.ulp(0.0)


def is_affine(call) -> bool:
    return call.namespace == "f" and call.function in MAPS


def composed(a, b, rows) -> tuple[float, float]:
    """The map (a, b), then those of the rows."""
    for p, q in rows:
        scaled = a * p
        a = scaled if scaled or not p or not a else math.copysign(TINY, a) * math.copysign(1.0, p)
        b = p * b + q
    return a, b


def applied(state: float | None, x: float, a: float, b: float, rest_a: float, rest_b: float) -> float:
    """The state after a bucket; None before the first row of all."""
    state = x if state is None else a * state + b
    return rest_a * state + rest_b if state else rest_b


def starts(work: DataFrame, seq: Column, calls: list, args: list[list[str]]) -> DataFrame:
    """One row a bucket, a column a call (null: no row came before)."""
    functions = [(c.function, c.zeros) for c in calls]
    names = [f"__start{j}" for j in range(len(calls))]
    parts = [f"{n}_{p}" for n in names for p in PARTS]

    def schema(columns):
        return T.StructType([T.StructField(BUCKET, T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in columns]])

    def table(columns, rows):
        import pyarrow as pa

        kinds = [pa.int32(), *[pa.float64()] * len(columns)]
        values = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [BUCKET, *columns])

    def compose(batches):
        at, held = None, []
        for batch in batches:
            buckets = batch.column(BUCKET).to_numpy(zero_copy_only=False)
            rows, made = [], []
            for (function, zeros), own in zip(functions, args, strict=True):
                values = [batch.column(c).fill_null(z).to_numpy(zero_copy_only=False).astype(float) for c, z in zip(own, zeros, strict=True)]
                with np.errstate(all="ignore"):
                    a, b = MAPS[function](*values)
                rows.append((values[0].tolist(), a.tolist(), b.tolist()))
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)] if len(buckets) else [0]
            for i, end in zip(cuts, cuts[1:], strict=False):
                if buckets[i] != at:
                    if held:
                        made.append([at, *[v for h in held for v in h]])
                    at, held = int(buckets[i]), [(x[i], a[i], b[i], 1.0, 0.0) for x, a, b in rows]
                    i += 1
                held = [(*h[:3], *composed(h[3], h[4], zip(a[i:end], b[i:end], strict=True))) for h, (_, a, b) in zip(held, rows, strict=True)]
            yield table(parts, made)
        if held:
            yield table(parts, [[at, *[v for h in held for v in h]]])

    def carry(batches):
        states = [None] * len(names)
        for batch in batches:
            made = []
            for bucket, *maps in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                made.append([bucket, *states])
                states = [applied(s, *maps[j * len(PARTS) : (j + 1) * len(PARTS)]) for j, s in enumerate(states)]
            yield table(names, made)

    narrow = work.select(BUCKET, seq.alias("__order"), *[c for own in args for c in own])
    maps = narrow.repartition(BUCKET).sortWithinPartitions(BUCKET, "__order").mapInArrow(compose, schema(parts))
    return maps.coalesce(1).sortWithinPartitions(BUCKET).mapInArrow(carry, schema(names))
