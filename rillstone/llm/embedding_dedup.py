"""Embedding near-duplicates by collision-counting projections [free style].

Unit vectors are projected onto ``PROJECTIONS`` random lines. Two vectors collide on a line if their projections differ by at
most the window, which is centred on each vector. Counting goes in two steps. Each of the first ``FIRST`` lines is sorted, the
windows are found by binary search, and every vector that falls into a window adds one to the pair's count; pairs that reach
``needed`` of these lines are counted on the others too. Pairs that pass both counts are verified by cosine in double
precision. Window and counts are calibrated by the normal law of projections: two unit vectors of cosine c differ on a
Gaussian line by a normal variable of variance 2 - 2c.

A window of a line holds about a quarter of all vectors, so windows over a whole label hold a number of pairs that is quadratic
in it. Counting is done in cells: in each of several rounds a label is cut by ``bits`` random hyperplanes through its mean, and
the sides taken form a cell's code. Bits and rounds are planned for each label on its own, from its size and its mean over
all its vectors: a pair at the threshold lies on one side of a hyperplane with probability 1 - angle / pi, the angle seen from
the mean, and rounds are as many as it takes for such a pair to share a cell in one of them with probability ``CELL_RECALL``.
Where that takes more than ``MOST_ROUNDS``, fewer hyperplanes are taken and cells are larger. A pair is counted only in
the first round that brings it together, which either side can tell from both codes, so link counts need no list of pairs.
Cells of more than ``block`` vectors are compared block by block in tasks of their own.

Equal vectors of a label are merged first: groups of copies of any size are one point with a multiplicity.

Defined results: a null label or a vector that is null, zero, or holds null or non-finite components links with nothing (0
links, component itself, kept); a null vec_id keeps a row with 0 links; vectors of different lengths never link; repeated
rows count as vectors of their own; other columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, table
from .components import connected_components

THRESHOLD = 0.93
PROJECTIONS, FIRST = 48, 16
CELL, BLOCK = 768, 1_024
CELL_RECALL, COUNT_RECALL = 0.988, 0.998
MOST_ROUNDS, MOST_BITS = 48, 40
SEED = 20_240_229


def lines(dim: int, count: int, seed: int) -> np.ndarray:
    """Gaussian directions, the same on every machine; more of them begin with the same ones."""
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((count, dim)).T


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in two steps so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def calibrated(threshold: float, projections: int, recall: float) -> tuple[float, int]:
    """(window, needed): a pair at the threshold collides on ``needed`` lines or more with probability ``recall``."""
    spread = math.sqrt(2 - 2 * threshold)
    p = math.erf(1.25 / math.sqrt(2))  # the window is 1.25 deviations of a pair at the threshold
    miss, needed = 0.0, 0
    while (miss := miss + math.comb(projections, needed) * p**needed * (1 - p) ** (projections - needed)) <= 1 - recall:
        needed += 1
    return 1.25 * spread, needed


def cuts_for(n: int, spread: float, cell: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, rounds) for a label of n vectors whose mean squared distance from their mean is ``spread``."""
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, n / cell)))))
    cosine = 1 - (1 - threshold) / max(spread, 1e-9)  # of a pair at the threshold, seen from the mean
    same = 1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    for b in range(bits, 0, -1):
        rounds = max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-300, 1 - same**b))))
        if rounds <= MOST_ROUNDS:
            return b, rounds
    return 0, 1


def matrices(batch: pa.RecordBatch):
    """(label, rows, unit vectors) for each label of a batch; a label's vectors have one length."""
    at = defaultdict(list)
    for i, label in enumerate(batch.column("label").to_pylist()):
        at[label].append(i)
    vectors = batch.column("v").to_pylist()
    for label, rows in at.items():
        yield label, rows, units(np.array([vectors[i] for i in rows], float))


def slices(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            yield batch.slice(i, 4096)


def plans_of(points: DataFrame, cell: int, threshold: float) -> DataFrame:
    """(label, bits, rounds, mean) for every label: sums are added up in slices first, so a hot label is a few rows by task."""

    def sums(batches):
        for part in slices(batches):
            made = [(label, len(rows), x.sum(axis=0).tolist()) for label, rows, x in matrices(part)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.list_(pa.float64()))], ["label", "n", "sums"])

    parts = points.select("label", "v").mapInArrow(sums, "label string, n long, sums array<double>")
    means = parts.select("label", "n", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("n").alias("n"), (F.sum("col") / F.sum("n")).alias("m"))
    means = means.groupBy("label").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean"))

    def plan(batches):
        for batch in batches:
            made = [cuts_for(n, 1 - sum(m * m for m in mean), cell, threshold, CELL_RECALL) for n, mean in zip(batch.column("n").to_pylist(), batch.column("mean").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([b for b, _ in made], pa.int32()), pa.array([r for _, r in made], pa.int32()), batch.column("mean")], ["label", "bits", "rounds", "mean"])

    return means.mapInArrow(plan, "label string, bits int, rounds int, mean array<double>")


def coded_by(plans: DataFrame, points: DataFrame, seed: int) -> DataFrame:
    """The points with the codes of their cells, one for each round of their label."""
    kept = ["rep", "copies", "label", "v"]

    def encode(batches):
        for part in slices(batches):
            codes: list = [None] * part.num_rows
            bits_of, rounds_of, means = (part.column(c) for c in ("bits", "rounds", "mean"))
            for _, rows, x in matrices(part):
                bits, rounds = bits_of[rows[0]].as_py(), rounds_of[rows[0]].as_py()
                own = np.zeros((len(rows), 1), np.int64)
                if bits:
                    mean = np.array(means[rows[0]].as_py())
                    side = (x - mean) @ lines_of(len(mean), bits * rounds, seed) > 0
                    own = side.reshape(len(rows), rounds, bits) @ (1 << np.arange(bits, dtype=np.int64))
                for i, code in zip(rows, own, strict=True):
                    codes[i] = code
            ends = np.cumsum([0, *map(len, codes)])
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], [*kept, "codes"])

    kind = points.schema["v"].dataType.simpleString()
    joined = points.select(*kept).join(plans.hint("merge"), "label").select(*kept, "bits", "rounds", "mean")
    return joined.mapInArrow(encode, f"rep long, copies long, label string, v {kind}, codes array<long>")


def collisions(proj: np.ndarray, window: float, first: int, needed_first: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows, a < b, that collide on enough of the lines (columns): on ``needed_first`` of the first ones, which
    are sorted and searched, and on ``needed`` of all."""
    n = len(proj)
    counts = np.zeros(n * n, np.uint8)
    place = np.arange(n)
    for k in range(first):
        order = np.argsort(proj[:, k], kind="stable")
        values = proj[order, k]
        sizes = np.searchsorted(values, values + np.float32(window), side="right") - place - 1  # the half of each window above it
        ends = np.cumsum(sizes)
        a = np.repeat(order, sizes)
        b = order[np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(place + 1, sizes)]
        counts[np.minimum(a, b) * n + np.maximum(a, b)] += 1  # a line gives a pair once
    at = np.flatnonzero(counts >= needed_first)
    a, b, n_hits = at // n, at % n, counts[at].astype(np.int64)
    for k in range(first, proj.shape[1]):
        n_hits += np.abs(proj[a, k] - proj[b, k]) <= window
    keep = n_hits >= needed
    return a[keep], b[keep]


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, projections: int = PROJECTIONS, cell: int = CELL, block: int = BLOCK, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    if rows.schema["v"].dataType.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    bad = F.expr("exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & ~bad & F.expr("exists(v, x -> x <> 0)"), F.lit(False))
    rows = stored(rows.withColumn("good", good), "vectors")
    # vectors of different lengths never link, so the length is a part of the label from here on
    label = F.concat_ws(":", F.size("v").cast("string"), "label")
    key = F.sha2(F.concat(F.array_join("v", ","), F.lit(";"), "label"), 256)
    keyed = stored(rows.where("good").select("id", key.alias("key"), label.alias("label"), "v"), "vectors-keyed")
    points = stored(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")), "vectors-points")
    plans = stored(plans_of(points, cell, threshold), "vectors-plans")
    window, needed = calibrated(threshold, projections, COUNT_RECALL)
    first = min(FIRST, projections)
    needed_first = calibrated(threshold, first, COUNT_RECALL)[1]
    coded = stored(coded_by(plans, points, seed + 1), "vectors-coded")
    sizes = coded.select("label", F.posexplode("codes").alias("round", "code")).groupBy("label", "round", "code").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes.select("label", "round", "code", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "vectors-cells")
    cells = coded.select("rep", "copies", "label", "v", "codes", F.posexplode("codes").alias("round", "code"))
    placed = cells.join(sizes, ["label", "round", "code"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("label", "round", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "v", "codes")

    def count(group: pa.Table) -> pa.Table:
        """Link counts of a cell's (or two blocks') vectors, and edges that span what it links."""
        x = units(np.array(group.column("v").to_pylist(), float))
        rep, copies, own = (group.column(c).to_numpy() for c in ("rep", "copies", "own"))
        a, b = collisions((x @ lines_of(x.shape[1], projections, seed)).astype(np.float32), window, first, needed_first, needed)
        if group.column("i")[0].as_py() != group.column("j")[0].as_py():
            keep = own[a] != own[b]
            a, b = a[keep], b[keep]
        if this := group.column("round")[0].as_py():  # pairs that an earlier round has brought together are counted there
            codes = np.array(group.column("codes").to_pylist(), np.int64)[:, :this]
            keep = ~(codes[a] == codes[b]).any(axis=1)
            a, b = a[keep], b[keep]
        near = [np.einsum("ij,ij->i", x[a[k : k + 8192]], x[b[k : k + 8192]]) >= threshold for k in range(0, len(a), 8192)]
        keep = np.concatenate(near) if near else np.zeros(0, bool)
        a, b = a[keep], b[keep]
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        label = np.arange(len(rep))
        while len(a):
            new = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(rep[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "b": pa.array(rep[label[some]], pa.int64())})

    found = stored(placed.groupBy("label", "round", "code", "i", "j").applyInArrow(count, "a long, links long, b long"), "vectors-links")
    discard(coded, sizes, plans)
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    components = connected_components(found.select("a", "b"))
    named = points.select("key", "rep", "copies").join(links, F.col("rep") == F.col("a"), "left").join(components.withColumnRenamed("id", "c"), F.col("rep") == F.col("c"), "left")
    named = stored(named.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vectors-named")
    discard(found, points)
    linked = keyed.select("id", "key").join(named, "key").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    others = rows.where(~F.col("good")).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


_lines: dict[tuple, np.ndarray] = {}


def lines_of(dim: int, count: int, seed: int) -> np.ndarray:
    key = (dim, count, seed)
    if key not in _lines:
        _lines[key] = lines(*key)
    return _lines[key]


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
