"""The arrival order of rows read from files: by modification time, then path, then place in the file.

Spark reads files in splits, large ones first, so neither the order of partitions nor ``monotonically_increasing_id`` tells which
row came first. The hidden column ``PLACE`` does: within a split rows keep their order, and a split's first byte comes after all
rows of the splits before it, as a row has one byte at least. Parquet files number their rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACE = "__place"
_SPLIT, _NUMBER = "__split", "__number"
#: The part of monotonically_increasing_id that counts rows in a partition.
_IN_PARTITION = (1 << 33) - 1


def with_split(df: DataFrame) -> DataFrame:
    """df of a file reader with the split of each row; call it before anything else."""
    m = F.col("_metadata")
    return df.withColumn(_SPLIT, F.struct(m["file_modification_time"].alias("time"), m["file_path"].alias("path"), m["file_block_start"].alias("start")))


def with_row_index(df: DataFrame) -> DataFrame:
    """df of a Parquet reader with the place of each row."""
    m = F.col("_metadata")
    return df.withColumn(PLACE, F.struct(m["file_modification_time"].alias("time"), m["file_path"].alias("path"), m["row_index"].alias("row")))


def with_place(df: DataFrame) -> DataFrame:
    """df with the place of each row instead of its split; nothing but maps may lie between the two."""
    if df.isStreaming:
        df, number = _numbered(df), F.col(_NUMBER)
    else:
        number = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))
    split = F.col(_SPLIT)
    return df.withColumn(PLACE, F.struct(split["time"].alias("time"), split["path"].alias("path"), (split["start"] + number).alias("row"))).drop(_SPLIT, _NUMBER)


def _numbered(df: DataFrame) -> DataFrame:
    """Streams have no built-in row number in a partition: rows are counted as they pass."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], [*batch.schema.names, _NUMBER])
            at += batch.num_rows

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField(_NUMBER, T.LongType())]))


def is_place(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == ["time", "path", "row"]


def as_text(place: Column) -> Column:
    """A place as a text that sorts like it."""
    return F.concat(F.lpad(F.unix_micros(place["time"]).cast("string"), 20, "0"), place["path"], F.lpad(place["row"].cast("string"), 20, "0"))


def file_of(text: Column) -> Column:
    """The file of a place given as text: texts of files sort like the files."""
    return F.left(text, F.length(text) - 20)


def row_of(text: Column) -> Column:
    return F.right(text, F.lit(20)).cast("long")


def numbered(df: DataFrame, file: Column, row: Column, name: str) -> tuple[DataFrame, int]:
    """df with a bigint that rises with (file, row), and the number past the last one. One aggregation; a row for each file comes to
    the driver, which lists the files anyway, and goes back as a broadcast."""
    files = df.groupBy(file.alias("file")).agg(F.max(row).alias("last"), F.min(row).alias("first")).collect()
    at, bases = 0, []
    for f in sorted(files, key=lambda f: f["file"]):
        bases.append((f["file"], at - f["first"]))
        at += f["last"] - f["first"] + 1
    kind = T.StructType([T.StructField("__file", df.select(file.alias("file")).schema[0].dataType), T.StructField("__base", T.LongType())])
    known = df.sparkSession.createDataFrame(bases, kind)
    return df.join(F.broadcast(known), file == F.col("__file"), "left").withColumn(name, F.col("__base") + row).drop("__file", "__base"), at
