"""SimHash near-duplicates found with a forest of vantage-point trees over fingerprints [free style].

Fingerprints: 64 bits; a bit is 1 if it is set in over half of the XXH64 values of the text's three-word shingles.

Search for all pairs within Hamming distance 3, exact:

* Equal fingerprints are merged first, so groups of copies of any size are one point each.
* If two fingerprints differ in 3 bits or fewer, one of their 32-bit halves differs in 1 bit at most. So there are two
  vantage-point trees, one on each half, searched with radius 1: at a node with vantage point v and radius m a point is inside
  if its distance to v is at most m. By the triangle inequality a partner on the other side of the border is within 1 of it,
  so only points at distance exactly m can have one outside, and only these are copied to the outside. (One tree on all
  64 bits with radius 3 would copy about twice as many points a level, see README.)
* Leaves are shards. In a shard, all pairs are compared on all 64 bits by popcounts; the shard returns edges that span its
  groups, never all pairs. A shard that vantage points can't divide (many equal halves) is split into blocks, and each pair
  of blocks is a task of its own, so no task grows with it.

Vantage points and radii come from a bounded sample (``sample`` fingerprints); where the sample is used up, hashes of the path
serve as vantage points. Every fingerprint is indexed and searched.

Defined results: null or empty text: fingerprint zero, linked like any other; repeated rows: equal fingerprints, one group;
a null id is a row of its own group of texts, whose component is the smallest id
that is not null; other columns are ignored, whatever their names; texts are never cut; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, mix64, settle, stored, table, text_rows
from .components import connected_components

RADIUS = 3
#: Fingerprints that trees are grown on, at most.
SAMPLE = 16_384
#: Points aimed at in a shard, and the most that are compared in one task (two blocks of so many).
SHARD, BLOCK = 512, 2_048
digest = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else [b" ".join(words)]
    n = max(1, len(words) - 2)
    hashes = np.fromiter(map(digest, shingles), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long, and the columns of longs to keep."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64)), *[batch.column(c) for c in keep]], ["id", "fp", *keep])

    return map_text(text_rows(docs, id_col, text_col, keep), "text", one, ", ".join(["id long, fp long", *[f"{c} long" for c in keep]]))


def grow(points: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree of vantage points on 32-bit values in heap order: (vantage points, radii) of its 2 ** depth - 1 inner nodes."""
    size = (1 << depth) - 1
    vantage = (mix64(np.arange(1, size + 1, dtype=np.uint64) + np.uint64(seed << 32)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    radius = np.full(size, 15, np.uint8)
    held = {0: points}
    for node in range(size):
        own = held.pop(node, None)
        if own is None or len(own) < 16:
            continue
        best = None
        for v in own[np.linspace(0, len(own) - 1, 4).astype(int)].tolist() + [int(vantage[node])]:
            d = np.bitwise_count(own ^ np.uint32(v))
            share = np.cumsum(np.bincount(d, minlength=33)) / len(own)
            border = np.bincount(d, minlength=33) / len(own)
            m = int(np.argmin(np.maximum(share + 0, 1 - share + border)))
            cost = max(share[m], 1 - share[m] + border[m])
            if best is None or cost < best[0]:
                best = (cost, v, m, d)
        _, vantage[node], radius[node], d = best
        inside = d <= radius[node]
        held[2 * node + 1] = own[inside]
        held[2 * node + 2] = own[~inside | (d == radius[node])]
    return vantage, radius


def shards_of(values: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(position, leaf) for every shard that each value belongs to."""
    vantage, radius = tree
    at, node = np.arange(len(values)), np.zeros(len(values), np.int64)
    while len(node) and node[0] < len(vantage):
        d = np.bitwise_count(values[at] ^ vantage[node])
        m = radius[node]
        inside, out = d <= m, d >= m
        at, node = np.concatenate([at[inside], at[out]]), np.concatenate([2 * node[inside] + 1, 2 * node[out] + 2])
    return at, node


def spanning(fps: np.ndarray, reps: np.ndarray, block: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the groups of points within the radius. block: only pairs of different blocks are compared."""
    n = len(fps)
    label = np.arange(n)
    left, right = [], []
    for i in range(0, n, 256):
        near = np.bitwise_count(fps[i : i + 256, None] ^ fps[None, i:]) <= radius
        if block is not None:
            near &= block[i : i + 256, None] != block[None, i:]
        a, b = np.nonzero(near)
        keep = a < b
        left.append(a[keep] + i)
        right.append(b[keep] + i)
    a, b = np.concatenate(left), np.concatenate(right)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return reps[own], reps[label[own]]


def near_edges(points: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the reps of points (fp, rep) that span all groups linked at the radius or less (3 at most)."""
    spark = points.sparkSession
    n = points.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard)))))
    some = np.array([r[0] for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast([grow((some >> np.uint64(s)).astype(np.uint32), min(depth, 20), s + 1) for s in (0, 32)])  # 2 ** 20 nodes at most

    def route(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t, s in enumerate((0, 32)):
                at, leaf = shards_of((fp >> np.uint64(s)).astype(np.uint32), trees.value[t])
                yield pa.RecordBatch.from_arrays([pa.array(leaf * 2 + t), *[batch.column(c).take(pa.array(at)) for c in ("fp", "rep")]], ["shard", "fp", "rep"])

    routed = stored(points.select("fp", "rep").mapInArrow(route, "shard long, fp long, rep long"), "simhash-shards")
    sizes = stored(routed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-sizes")
    rows = routed.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "rep")

    def compare(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        a, b = spanning(fp, group.column("rep").to_numpy(), None if i == j else group.column("own").to_numpy(), radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("shard", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest id reachable over links."""
    spark = docs.sparkSession
    rows = stored(fingerprints(docs, id_col, text_col), "simhash")
    points = stored(rows.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-points")
    found = connected_components(near_edges(points.where("rep is not null")))
    named = stored(points.join(found, F.col("rep") == F.col("id"), "left").select("fp", F.coalesce("component", "rep").alias("component")), "simhash-named")
    settle(spark)
    return rows.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def near_groups(docs: DataFrame, keep: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, group) and the columns of longs to keep, for every row; group is the smallest fingerprint reachable over links. Ids
    play no part, so rows without id have groups and rows that share an id are in one group only if their texts are near."""
    rows = stored(fingerprints(docs, id_col, text_col, keep), "simhash")
    points = stored(rows.select("fp", F.col("fp").alias("rep")).distinct(), "simhash-points")
    found = connected_components(near_edges(points)).select(F.col("id").alias("rep"), F.col("component").alias("found"))
    named = stored(points.join(found, "rep", "left").select("fp", F.coalesce("found", "fp").alias("group")), "simhash-named")
    settle(docs.sparkSession)
    return rows.join(named, "fp").select("id", "fp", "group", *keep)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
