"""Shared parts of the training-data operators.

Texts reach Python in Arrow batches. ``text_slices`` cuts a batch into pieces of a few megabytes so that the memory a worker
needs does not follow the batch size; a single longer text forms a slice of its own and is never cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a Python worker (a longer single text is handled whole).
SLICE_BYTES = 4_000_000


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch holding about ``limit`` bytes of ``column`` each; one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = batch.column(column).cast(pa.large_binary()) if pa.types.is_string(batch.column(column).type) else batch.column(column)
    lengths = np.array([0 if x is None else x for x in pa.compute.binary_length(sizes).to_pylist()], dtype=np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_text(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, setup: Callable | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of about ``limit`` bytes. ``setup()`` runs once per task and its value is handed to ``fn`` as second argument."""

    def run(batches):
        held_of_stage()
        state = setup() if setup else None
        for batch in batches:
            for part in text_slices(batch, column, limit):
                out = fn(part, state) if setup else fn(part)
                if out is not None and out.num_rows:
                    yield out
        state = batch = part = out = None
        _give_back()

    return df.mapInArrow(run, schema)


_held: dict = {"stage": None, "items": {}}


def held_of_stage() -> dict:
    """What tasks of the running stage share in this worker process. A task of another stage starts with nothing, so what one
    operator has built doesn't stay in memory while workers, which Spark uses again, run others."""
    from pyspark import TaskContext

    task = TaskContext.get()
    stage = task.stageId() if task else None
    if stage != _held["stage"]:
        _held["stage"], _held["items"] = stage, {}
        _give_back()
    return _held["items"]


def _give_back() -> None:
    """Hands freed memory back to the system, so that what an earlier stage needed doesn't stay with the worker."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def held(key, make: Callable):
    """make() once for the tasks of a stage in a worker process."""
    items = held_of_stage()
    if key not in items:
        items[key] = make()
    return items[key]


class Ordinals(dict):
    """Gives each distinct key the next integer; ``fresh`` lists the keys seen first since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        self[key] = value = len(self)
        self.fresh.append(key)
        return value

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), dtype=np.int64, count=len(keys))


class Growing:
    """An array that grows at its end; room is kept, so that small additions don't copy the whole."""

    def __init__(self, dtype):
        self._room, self._n = np.zeros(1024, dtype), 0

    @property
    def values(self) -> np.ndarray:
        return self._room[: self._n]

    def add(self, more: np.ndarray) -> None:
        n = self._n + len(more)
        if n > len(self._room):
            room = np.empty(max(n, len(self._room) * 5 // 4), self._room.dtype)
            room[: self._n] = self.values
            self._room = room
        self._room[self._n : n] = more
        self._n = n


class ChunkTable:
    """Distinct chunks, each encoded once; values are joined back to positions by gathering.

    ``encode`` maps a list of new chunks to a list of sequences, or to an array with a row for each. The table is emptied when it holds more than ``limit``
    chunks, so its memory is bounded however many distinct chunks a partition has; only repeated work is lost then.
    """

    def __init__(self, encode: Callable[[list], list | np.ndarray], dtype, limit: int = 400_000):
        self.encode, self.dtype, self.limit = encode, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.index = Ordinals()
        self._flat, self._starts, self._lengths = Growing(self.dtype), Growing(np.int64), Growing(np.int64)

    @property
    def flat(self) -> np.ndarray:
        return self._flat.values

    @property
    def starts(self) -> np.ndarray:
        return self._starts.values

    @property
    def lengths(self) -> np.ndarray:
        return self._lengths.values

    def lookup(self, chunks: list) -> np.ndarray:
        """Ordinals of the chunks; unseen ones are encoded."""
        if len(self.index) > self.limit:
            self.clear()
        at = self.index.of(chunks)
        if self.index.fresh:
            values = self.encode(self.index.fresh)
            self.index.fresh = []
            if isinstance(values, np.ndarray):
                lengths, flat = np.full(len(values), values.shape[1]), values.ravel()
            else:
                lengths = np.fromiter(map(len, values), np.int64, len(values))
                flat = np.concatenate([np.asarray(v, self.dtype) for v in values]) if lengths.sum() else np.zeros(0, self.dtype)
            self._starts.add(len(self._flat.values) + np.cumsum(lengths) - lengths)
            self._lengths.add(lengths)
            self._flat.add(flat)
        return at

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The values of the chunks at these ordinals, one after the other."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self._flat.values[np.repeat(self._starts.values[at] - (ends - lengths), lengths) + np.arange(total)]


def rebuilt(df: DataFrame, columns: list, column: str, extra: dict, fn: Callable[[list, pa.RecordBatch], list]) -> DataFrame:
    """The columns of df with the texts of one replaced: fn(texts, batch) gives the new ones, batch holds the ``extra`` columns by name.
    Columns go by position inside, so none of their names can clash; slices are bounded as in ``map_text``."""
    schema = df.select(*columns).schema
    names = [f"c{i}" for i in range(len(columns))]
    at = schema.names.index(column)
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema, strict=True))
    rows = df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], *[c.alias(n) for n, c in extra.items()])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array(fn(batch.column(names[at]).to_pylist(), batch), pa.string())
        return pa.RecordBatch.from_arrays([texts if i == at else batch.column(n) for i, n in enumerate(names)], names)

    return map_text(rows, names[at], one, fields).toDF(*schema.names)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def ragged(values, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array; offsets has one entry more than there are rows."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine serves a
    local session, as in tests; a cluster has no such folder, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/rillstone-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows to the shared folder and reads them back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    fs, target = _at(spark, path)
    fs.delete(target, True)


def discard(*frames: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote; call it when what was derived from them is itself written."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


def settle(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs: its cleaner acts when the driver has collected unused references."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Only the needed columns, under names of our own; a clash with other columns can't arise."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(c) for c in keep])
