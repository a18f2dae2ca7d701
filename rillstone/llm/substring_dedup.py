"""Repeated passages removed by a log-structured fingerprint index [free style].

A window is 35 consecutive words. Every word covered by a window whose word sequence also starts anywhere else is removed.

* Anchors. Among the eight-word sequences inside a window the one with the least hash is its anchor. Equal windows have equal
  anchors at equal places, and about one word in thirteen starts an anchor, so a window can only repeat if its anchor does.
* Index. ``FingerprintIndex`` lives in a folder and is opened again by later sessions. A batch's anchors are counted and written
  as an immutable run: files bucketed and sorted by hash. The run is merge-joined, bucket by bucket and without a shuffle, with
  the runs of earlier batches, which tells the batch's anchors that repeat in it or in history. Two runs of a tier are then
  compacted into one of the next tier by another merge-join, so history is a logarithmic number of runs. A batch's postings
  (documents with their anchors) are kept as well.
* Verification. Consecutive windows that share a repeated anchor form a segment. Segments equal as a whole (64-bit hash of
  all their words, besides the anchor's own) repeat with all their windows, whatever the number of copies. Of each distinct
  segment one is compared window by window, by a 64-bit hash of the 35 words within the same anchor, which finds the
  windows shared by segments that differ elsewhere, as at the borders of passages. Anchors and windows are hashed by
  polynomials of different bases, so two windows count as equal only where both 64-bit values agree.
* Removal marks go back to their documents, so no task ever holds the occurrences of a passage; counts are aggregated
  map-side. A mark is a word position and a bitmask of the windows that start there and behind it.

Defined results: null or empty text: no words, digest of the empty string; fewer than 35 words: nothing removed; a passage
that repeats in one document, repeated rows included, is removed at all its places; texts are read whole; an empty table gives
no rows; other columns are ignored, or kept by ``removed`` whatever their names; rows without id are documents like others.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkTable, discard, exists, map_text, mix64, ragged, rebuilt, remove, settle, shared_dir, stored, table

WINDOW, ANCHOR = 35, 8
#: Batches that a table is fed to the index in.
BATCHES = 2
#: Windows of a segment, at most: their verdicts are the bits of a long.
SEGMENT = 56
#: Bases of the polynomials over words: of anchors, and of windows.
BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def power(n: int, base: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[:, None]


def spans_of(h: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """Hashes of all sequences of ``length`` words, from the words' hashes, by doubling."""
    out, size = None, 0
    piece, piece_size = h, 1
    while length:
        if length & 1:
            n = len(h) - size - piece_size + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            out = piece if out is None else out[:n] * power(piece_size, base) + piece[size : size + n]
            size += piece_size
        length >>= 1
        if length:
            n = len(piece) - piece_size
            if n <= 0:
                return np.zeros(0, np.uint64)
            piece = piece[:n] * power(piece_size, base) + piece[piece_size : piece_size + n]
            piece_size *= 2
    return out


def sliding(x: np.ndarray, length: int, fold) -> np.ndarray:
    """fold over every ``length`` consecutive values."""
    size = 1
    while size * 2 <= length:
        x = fold(x[:-size], x[size:])
        size *= 2
    return fold(x[: len(x) - (length - size)], x[length - size :]) if size < length else x


class Windows:
    """Hashes of a slice's words, and what windows over them say; documents are told apart by ``doc``."""

    def __init__(self, texts: list, chunks: ChunkTable):
        lists = [t.encode().split() if t else [] for t in texts]
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.cumsum(self.sizes) - self.sizes
        at = chunks.lookup([w for x in lists for w in x])
        self.h = chunks.flat[at] if len(at) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(lists)), self.sizes)
        self.n = max(0, len(self.h) - WINDOW + 1)
        if self.n:
            self.ok = self.doc[: self.n] == self.doc[WINDOW - 1 :]
            self.gram = mix64(spans_of(self.h, ANCHOR))
            self.least = sliding(self.gram, WINDOW - ANCHOR + 1, np.minimum)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of every anchor position: it has the least hash of some window."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        pad = np.zeros(WINDOW - ANCHOR, np.uint64)
        highest = sliding(np.concatenate([pad, np.where(self.ok, self.least, np.uint64(0)), pad]), WINDOW - ANCHOR + 1, np.maximum)
        at = np.flatnonzero(highest == self.gram)
        return self.doc[at], self.gram[at]

    def segments(self, wanted: list) -> dict[str, np.ndarray]:
        """Runs of consecutive windows with the same anchor hash (at most SEGMENT of them), for hashes wanted by their document:
        doc, anchor, hash of all words, first window in the document, and the windows' hashes with offsets."""
        found: list[np.ndarray] = []
        for i, (own, start, size) in enumerate(zip(wanted, self.starts.tolist(), self.sizes.tolist(), strict=True)):
            m = self.least[start : start + size - WINDOW + 1] if size >= WINDOW else np.zeros(0, np.uint64)
            if len(m) and len(own):
                own = np.sort(np.asarray(own, np.int64).view(np.uint64))
                hit = own[np.minimum(np.searchsorted(own, m), len(own) - 1)] == m
                if hit.any():
                    edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                    along = np.arange(len(m)) - np.repeat(edge, np.diff(np.append(edge, len(m))))
                    edge = np.flatnonzero(along % SEGMENT == 0)
                    ends = np.append(edge[1:], len(m))
                    keep = hit[edge]
                    found.append(np.column_stack([np.full(keep.sum(), i), edge[keep], ends[keep]]))
        runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        doc, lo, hi = runs.T
        n = hi - lo
        first = self.starts[doc] + lo
        whole = np.zeros(len(doc), np.uint64)
        hashes = mix64(spans_of(self.h, WINDOW, WINDOW_BASE)) if self.n else np.zeros(0, np.uint64)
        ends = np.cumsum(n)
        at = np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        values = hashes[at]
        if len(doc):  # the windows of a segment hold all its words
            weights = mix64((np.arange(len(at)) - np.repeat(ends - n, n)).astype(np.uint64)) | np.uint64(1)
            whole = mix64(np.add.reduceat(values * weights, ends - n) + n.astype(np.uint64))
        return {"doc": doc, "anchor": self.least[first] if len(doc) else whole, "whole": whole, "lo": lo, "values": values, "offsets": np.concatenate([[0], ends])}


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): key tells rows of equal id and different text apart."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def table_of_words() -> ChunkTable:
    return ChunkTable(hash_words, np.uint64, 300_000)


@contextmanager
def partitions(spark: SparkSession, n: int):
    """Shuffles deal out n partitions and keep them, so that one holds one bucket."""
    names = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def postings_of(rows: DataFrame, keep: tuple = ()) -> DataFrame:
    """(key, anchors) of rows (key, text), and the long columns to keep."""

    def one(part: pa.RecordBatch, chunks: ChunkTable) -> pa.RecordBatch:
        w = Windows(part.column("text").to_pylist(), chunks)
        doc, gram = w.anchors()
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
        return pa.RecordBatch.from_arrays([part.column("key"), ragged(gram.view(np.int64), offsets, pa.int64()), *[part.column(c) for c in keep]], ["key", "anchors", *keep])

    return map_text(rows, "text", one, "key long, anchors array<long>" + "".join(f", {c} long" for c in keep), table_of_words)


class FingerprintIndex:
    """Sorted immutable runs of anchor counts in a folder, compacted by tiers; the folder outlives the session.

    What is live is told by the latest manifest, written last, so a batch that was broken off leaves the index as it was.
    ``buckets`` is fixed when the folder is made: runs are co-partitioned by it for ever.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = {"version": 0, "batches": 0, "runs": [], "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))}
        if exists(spark, f"{self.folder}/manifest"):
            last = spark.read.schema("value string, version int").text(f"{self.folder}/manifest").orderBy(F.desc("version")).first()
            self.state = json.loads(last["value"]) if last else self.state

    # -- runs ----------------------------------------------------------------------------------------------------------

    def _table(self, run: str) -> str:
        """The catalog's name of a run; a session that doesn't know it yet is told where its files lie."""
        name = f"rillstone_{zlib.crc32(self.folder.encode()):08x}_{run}"
        self.spark.sql(f"create table if not exists {name} (anchor bigint, n bigint) using parquet clustered by (anchor) sorted by (anchor) into {self.state['buckets']} buckets location '{self.folder}/runs/{run}'")
        return name

    def run(self, run: str) -> DataFrame:
        """(anchor, n) of a run, read by buckets."""
        return self.spark.table(self._table(run))

    def _write(self, run: str, counts: DataFrame) -> None:
        path = f"{self.folder}/runs/{run}"
        remove(self.spark, path)  # of a batch that was broken off
        name = f"rillstone_{zlib.crc32(self.folder.encode()):08x}_{run}"
        self.spark.sql(f"drop table if exists {name}")
        counts.write.bucketBy(self.state["buckets"], "anchor").sortBy("anchor").option("path", path).format("parquet").saveAsTable(name)

    def merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one, by a merge-join of their buckets."""
        x, y = self.run(a).select("anchor", F.col("n").alias("x")), self.run(b).select("anchor", F.col("n").alias("y"))
        return x.join(y.hint("merge"), "anchor", "full").select("anchor", (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).cast("long").alias("n"))

    def repeating(self, run: str, earlier: list[str]) -> DataFrame:
        """Anchors of a run that it holds twice or more, or that an earlier run holds, by merge-joins of their buckets."""
        out = self.run(run)
        for e in earlier:
            out = out.join(self.run(e).select("anchor", F.col("n").alias("m")).hint("merge"), "anchor", "left").select("anchor", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        return out.where("n >= 2").select("anchor")

    # -- batches -------------------------------------------------------------------------------------------------------

    def ingest(self, rows: DataFrame) -> int:
        """Adds a batch of rows (key, text), or (key, anchors) where postings are made already; the batch's number."""
        s, number = dict(self.state), self.state["batches"]
        made = rows if "anchors" in rows.columns else postings_of(rows.select("key", "text"))
        made.select("key", "anchors").write.mode("overwrite").parquet(f"{self.folder}/postings/batch={number}")
        postings = self.spark.read.schema("key long, anchors array<long>").parquet(f"{self.folder}/postings/batch={number}")
        with partitions(self.spark, s["buckets"]):
            counts = postings.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n"))
            self._write(f"b{number}", counts)
            earlier = [r for r, _ in s["runs"]]
            self.repeating(f"b{number}", earlier).write.mode("overwrite").parquet(f"{self.folder}/again/batch={number}")
            runs, gone = [*s["runs"], [f"b{number}", 0]], []
            while len(runs) > 1 and runs[-1][1] == runs[-2][1]:
                (a, tier), (b, _) = runs[-2:]
                made_of = f"m{number}_{tier + 1}"
                self._write(made_of, self.merged(a, b))
                runs = [*runs[:-2], [made_of, tier + 1]]
                gone += [a, b]
        self.state = {**s, "version": s["version"] + 1, "batches": number + 1, "runs": runs}
        line = self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1)
        line.write.mode("overwrite").text(f"{self.folder}/manifest/version={self.state['version']}")
        for run in gone:
            self._forget(run)
        return number

    def repeated(self, since: int = 0) -> DataFrame:
        """(key, anchors) of all documents, history included, with anchors that repeat in batch ``since`` or a later one."""
        if not self.state["batches"]:
            return self.spark.createDataFrame([], "key long, anchors array<long>")
        numbers = [f"{self.folder}/again/batch={b}" for b in range(since, self.state["batches"])]
        again = stored(self.spark.read.schema("anchor long").parquet(*numbers).distinct(), "passages-again")  # plain, so that Spark can split a hot anchor's postings
        every = self.spark.read.schema("key long, anchors array<long>").parquet(*[f"{self.folder}/postings/batch={b}" for b in range(self.state["batches"])])
        hits = every.select("key", F.explode("anchors").alias("anchor")).join(again.hint("merge"), "anchor")
        out = stored(hits.groupBy("key").agg(F.collect_set("anchor").alias("anchors")), "passages-hits")
        discard(again)
        return out

    def _forget(self, run: str) -> None:
        self.spark.sql(f"drop table if exists {self._table(run)}")
        remove(self.spark, f"{self.folder}/runs/{run}")

    def drop(self) -> None:
        """Deletes the index."""
        for run, _ in self.state["runs"]:
            self._forget(run)
        remove(self.spark, self.folder)


def removal_marks(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """(key, marks array<struct<lo,mask>>) from rows (key, text) and their repeated anchors: bit i of mask says that the window at
    word lo + i of the document repeats."""

    def one(part: pa.RecordBatch, chunks: ChunkTable) -> pa.RecordBatch | None:
        w = Windows(part.column("text").to_pylist(), chunks)
        if not w.n:
            return None
        s = w.segments(part.column("anchors").to_pylist())
        return pa.RecordBatch.from_arrays(
            [pa.array(s["anchor"].view(np.int64)), pa.array(s["whole"].view(np.int64)), part.column("key").take(pa.array(s["doc"])), pa.array(s["lo"], pa.int32()), ragged(s["values"].view(np.int64), s["offsets"], pa.int64())],
            ["anchor", "whole", "key", "lo", "windows"],
        )

    segments = stored(map_text(rows.join(hits, "key").select("key", "text", "anchors"), "text", one, "anchor long, whole long, key long, lo int, windows array<long>", table_of_words), "passages-segments")
    settle(rows.sparkSession)
    distinct = stored(segments.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min("windows").alias("windows")), "passages-distinct")
    windows = distinct.select("anchor", "whole", F.col("n").alias("copies"), F.posexplode("windows").alias("at", "window"))
    shared = stored(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n >= 2").select("anchor", "window"), "passages-shared")
    settle(rows.sparkSession)
    single = windows.where("copies = 1").join(shared, ["anchor", "window"])
    masks = single.groupBy("anchor", "whole").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    full = distinct.where("n >= 2").select("anchor", "whole", F.expr("shiftleft(1L, size(windows)) - 1").alias("mask"))
    verdicts = stored(masks.union(full), "passages-verdicts")
    discard(distinct, shared)
    marks = segments.select("anchor", "whole", "key", "lo").join(verdicts, ["anchor", "whole"])
    out = stored(marks.groupBy("key").agg(F.collect_set(F.struct("lo", "mask")).alias("marks")), "passages-marks")
    discard(segments, verdicts)
    settle(rows.sparkSession)
    return out


def marked_at_once(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Removal marks of a table by an index of its own: texts are read once for the anchors of all batches."""
    spark = rows.sparkSession
    index = FingerprintIndex(spark, shared_dir(spark, "passages-index"))
    numbered = rows.select("key", "text", F.pmod(F.xxhash64("key"), F.lit(batches)).alias("batch"))
    postings = stored(postings_of(numbered, ("batch",)), "passages-postings")
    for b in range(batches):
        index.ingest(postings.where(F.col("batch") == b))
        settle(spark)
    discard(postings)
    hits = index.repeated()
    index.drop()
    marks = removal_marks(rows, hits)
    discard(hits)
    return marks


def starts_of(marks: pa.Array, first: np.ndarray) -> np.ndarray:
    """Where repeating windows start, by words counted over all rows; first: each row's first word."""
    flat = marks.flatten()
    if not len(flat):
        return np.zeros(0, np.int64)
    lengths = np.array([n or 0 for n in pa.compute.list_value_length(marks).to_pylist()], np.int64)
    base = np.repeat(first, lengths) + flat.field("lo").to_numpy(zero_copy_only=False)
    bits = np.unpackbits(flat.field("mask").to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return base[row] + bit


def covered(sizes: np.ndarray, marks: pa.Array) -> list[np.ndarray]:
    """For each row which of its words repeating windows cover; sizes: numbers of words."""
    ends = np.cumsum(sizes)
    starts = np.unique(starts_of(marks, ends - sizes))
    change = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
    change[starts] += 1  # starts are distinct
    change[starts + WINDOW] -= 1
    return np.split(np.cumsum(change[:-1]) > 0, ends[:-1]) if len(ends) else []


def without(texts: list, marks: pa.Array) -> list[tuple[int, int, list]]:
    """For each text its number of words, how many are removed, and the kept ones."""
    lists = [t.encode().split() if t else [] for t in texts]
    out = []
    for words, gone in zip(lists, covered(np.fromiter(map(len, lists), np.int64, len(lists)), marks), strict=True):
        n = int(gone.sum())
        out.append((len(words), n, [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n else words))
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    rows = keyed(docs, id_col, text_col)
    marks = marked_at_once(rows.select("key", "text"), batches)

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, kept = zip(*without(part.column("text").to_pylist(), part.column("marks")), strict=True)
        sha = [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_text(rows.join(marks, "key", "left").select("id", "text", "marks"), "text", one, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """The documents without repeated passages: kept words joined by single spaces where any was removed, else the text as it
    was; other columns stay."""
    marks = marked_at_once(keyed(docs, id_col, text_col).select("key", "text"), batches)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    joined = docs.select(row.alias("row"), key.alias("key")).join(marks, "key", "left")

    def kept(texts: list, batch: pa.RecordBatch) -> list:
        at = without(texts, batch.column("marks"))
        return [b" ".join(words).decode() if gone else t for t, (_, gone, words) in zip(texts, at, strict=True)]

    return rebuilt(joined, [F.col("row")[c].alias(c) for c in docs.columns], text_col, {"marks": F.col("marks")}, kept)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
