"""Packing documents into fixed windows by non-negative least squares over the length histogram [free style].

1. Every document is tokenized once (distinct chunks between ASCII white space, each encoded once and joined back by position).
   Full windows are cut off its front; what is left over has a length below the window.
2. The histogram of left-over lengths has at most ``window`` entries, whatever the input. On the driver, shallow length
   combinations that fill a window exactly are enumerated, their repeat counts are solved by non-negative least squares
   against the histogram, rounded down, and residual lengths are packed greedily (largest first, best fit).
3. Left-overs that no combination holds are cut into powers of two. Equal powers fill windows without padding, so at most
   one sequence of the whole result is padded besides those within ``slack`` of full.
4. A left-over's rank among those of its length (per-task rank plus the counts of earlier tasks) says which repeat of which
   combination it belongs to, so assignment is arithmetic on a plan of bounded size and no sequence is ever gathered.

Defined results: null text counts as empty (one piece that holds only the end id); repeated rows are packed as often as they
occur; rows without id are packed like others; other columns are ignored, whatever their names; an empty table gives no
rows; a text of any length is handled whole.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ChunkTable, held, map_text, stored, table, text_rows

WINDOW = 4096
END_ID = 2
#: A greedily filled window within so many tokens of full is accepted.
SLACK = 8
#: Sequence ids of full windows start here; those of combinations start at 0.
FULL_BASE = 1 << 50

#: Bytes of text handled at once, and distinct chunks held: with more, the two workers of an executor leave too little room.
SLICE_BYTES, TABLE_CHUNKS = 1_000_000, 600_000

GAP = b"\x01"
#: Punctuation at the end of a chunk, after a letter or digit: the tokenizer never joins the two, so they are chunks of their own.
TRAIL = re.compile(rb"([.,!?;:#$%&*|](?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,!?;:#$%&*|]*)(?=[\x20\x09-\x0D]|\Z)")


class Tokens:
    """Ids of whole texts through a table of distinct chunks, shared by the tasks of a stage in a worker process."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        gap = self.tokenizer.encode(f"a {GAP.decode()} a", add_special_tokens=False).ids
        self.gap = gap[1:2] if len(gap) == 3 and gap[1] != gap[0] == gap[2] else []
        self.table = ChunkTable(self._encode, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32, limit=TABLE_CHUNKS)

    def _encode(self, chunks: list[bytes]) -> list:
        """One library call for all new chunks, kept apart by a control character whose id no other character can give."""
        if not self.gap or any(GAP in c for c in chunks):
            return [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
        joined = (b" " + GAP + b" ").join(chunks).decode()
        flat = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.table.dtype)
        cuts = np.concatenate([[-1], np.flatnonzero(flat == self.gap[0]), [len(flat)]]).tolist()
        return [flat[a + 1 : b] for a, b in zip(cuts[:-1], cuts[1:])]

    def chunks(self, text: str | None) -> list[bytes]:
        """The tokenizer drops white space and lower-cases, but finds its special tokens as they are written."""
        if not text:
            return []
        raw = text.encode()
        return raw.split() if any(s in text for s in self.specials) else TRAIL.sub(rb" \1", raw.lower()).split()

    def run(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and each text's number of ids."""
        lists = [self.chunks(t) for t in texts]
        at = self.table.lookup([c for x in lists for c in x])
        ends = np.concatenate([[0], np.cumsum(self.table.lengths[at])])[np.cumsum([0, *map(len, lists)])]
        return self.table.gather(at), np.diff(ends)


def powers(n: int) -> list[int]:
    """The powers of two that n is the sum of, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def tokenized(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each document: its length, CRCs of the pieces it may be cut into, and its rank in its task."""

    def setup():
        return held(("tokens", path), lambda: Tokens(path)), np.zeros(window + 1, np.int64), [0]

    def one(batch: pa.RecordBatch, state) -> pa.RecordBatch:
        tokens, seen, full_seen = state
        ids, counts = tokens.run(batch.column("text").to_pylist())
        ids = ids.astype("<u4")
        end = np.array([end_id], "<u4").tobytes()
        rows: dict[str, list] = {k: [] for k in ("doc_tokens", "rest", "rest_crc", "full_crcs", "power_crcs", "rank", "full_rank")}
        at = 0
        for n in counts.tolist():
            raw = ids[at : at + n].tobytes() + end
            at += n
            size, step = n + 1, window * 4
            rest = size % window
            cut = (size - rest) * 4
            tail = raw[cut:]
            rows["doc_tokens"].append(size)
            rows["rest"].append(rest)
            rows["full_crcs"].append([zlib.crc32(raw[i : i + step]) for i in range(0, cut, step)])
            rows["rest_crc"].append(zlib.crc32(tail))
            crcs, i = [], 0
            for p in powers(rest):
                crcs.append(zlib.crc32(tail[i : i + 4 * p]))
                i += 4 * p
            rows["power_crcs"].append(crcs)
            rows["rank"].append(int(seen[rest]))
            rows["full_rank"].append(full_seen[0])
            seen[rest] += 1
            full_seen[0] += size // window
        part = TaskContext.get().partitionId()
        kinds = {"full_crcs": pa.list_(pa.int64()), "power_crcs": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([part] * len(counts), pa.int64()), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()]], ["id", "part", *rows])

    return map_text(text_rows(docs), "text", one, "id long, part long, doc_tokens long, rest long, rest_crc long, full_crcs array<long>, power_crcs array<long>, rank long, full_rank long", setup, SLICE_BYTES)


def combinations(lengths: np.ndarray, window: int, spread: int = 12) -> list[np.ndarray]:
    """Combinations of two, three and four present lengths that sum to the window; for the deeper ones ``spread`` choices of
    the second length are tried for each first one. Each array has a row for a combination."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    pairs = np.array([(a, window - a) for a in lengths.tolist() if a >= window - a > 0 and there[window - a]], np.int64).reshape(-1, 2)
    triples, quads = [], []
    for a in lengths.tolist():
        rest = window - a
        b = lengths[(lengths <= min(a, rest - 1)) & (lengths >= (rest + 1) // 2)]
        b = b[there[rest - b]]
        if len(b):
            triples += [(a, x, rest - x) for x in np.unique(b[np.linspace(0, len(b) - 1, spread).astype(int)]).tolist()]
        for b in np.unique(lengths[lengths <= min(a, rest - 2)][:: max(1, len(lengths) // 4)]).tolist():
            left = rest - b
            c = lengths[(lengths <= min(b, left - 1)) & (lengths >= (left + 1) // 2)]
            c = c[there[left - c]]
            if len(c):
                quads += [(a, b, x, left - x) for x in np.unique(c[np.linspace(0, len(c) - 1, 4).astype(int)]).tolist()]
    return [x for x in (pairs, np.array(triples, np.int64).reshape(-1, 3), np.array(quads, np.int64).reshape(-1, 4)) if len(x)]


def solve(counts: np.ndarray, combos: list[np.ndarray], rounds: int = 250) -> list[np.ndarray]:
    """Non-negative least squares for the repeat counts, by accelerated projected gradient on the sparse matrix."""
    size = len(counts)

    def forward(x):
        return sum(np.bincount(c.ravel(), np.repeat(v, c.shape[1]), size) for c, v in zip(combos, x, strict=True))

    def back(r):
        return [r[c].sum(axis=1) for c in combos]

    v = [np.ones(len(c)) for c in combos]
    norm = 1.0
    for _ in range(12):
        v = back(forward(v))
        norm = np.sqrt(sum((a * a).sum() for a in v))
        v = [a / norm for a in v]
    x = [np.zeros(len(c)) for c in combos]
    y, t = x, 1.0
    for _ in range(rounds):
        g = back(forward(y) - counts)
        new = [np.maximum(0, a - b / (norm * 1.05)) for a, b in zip(y, g, strict=True)]
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = [a + (t - 1) / t2 * (a - b) for a, b in zip(new, x, strict=True)]
        x, t = new, t2
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, slack: int = SLACK) -> dict:
    """Which repeat of which combination the left-overs of each length belong to.

    ``segments``: (length, first rank, last rank + 1, first sequence, copies in one sequence, offset there); ``cut``: by length
    the first rank and number of left-overs to cut into powers of two; ``classes``: by power the first sequence, and the
    first position that goes to ``tail``, where the last pieces of all powers follow one another.
    """
    left = np.zeros(window + 1, np.int64)
    for n, k in histogram.items():
        if 0 < n < window:
            left[n] += k
    used = np.zeros(window + 1, np.int64)
    segments, sequence = [], 0

    def take(pattern: list[tuple[int, int]], repeats: int) -> None:
        nonlocal sequence
        offset = 0
        for n, copies in pattern:
            segments.append((n, int(used[n]), int(used[n]) + copies * repeats, sequence, copies, offset))
            used[n] += copies * repeats
            left[n] -= copies * repeats
            offset += n * copies
        sequence += repeats

    lengths = np.flatnonzero(left)
    combos = combinations(lengths, window)
    if combos:
        found = [(float(v), c) for x, rows in zip(solve(left.astype(float), combos), combos, strict=True) for v, c in zip(x, rows, strict=True) if v >= 1]
        for v, c in sorted(found, key=lambda f: (-f[0], f[1].tolist())):
            n, copies = np.unique(c, return_counts=True)
            if (repeats := int(min(int(v), (left[n] // copies).min()))) > 0:
                take([(int(a), int(b)) for a, b in zip(n[::-1], copies[::-1], strict=True)], repeats)
    present = np.flatnonzero(left).tolist()
    cut: dict[int, tuple[int, int]] = {}
    while present:
        first = present[-1]
        pattern, room, i = [], window, len(present) - 1
        while room and i >= 0:
            n = present[i]
            copies = min(int(left[n]), room // n)
            if copies:
                pattern.append((n, copies))
                room -= n * copies
            i = min(i - 1, bisect_right(present, room) - 1)
        if room <= slack:
            take(pattern, int(min(left[n] // c for n, c in pattern)))
        else:
            cut[first] = (int(used[first]), int(left[first]))
            left[first] = 0
        present = [n for n in present if left[n]]
    pieces: dict[int, int] = {}
    first_of: dict[tuple[int, int], int] = {}
    for n in sorted(cut):
        for p in powers(n):
            first_of[n, p] = pieces.get(p, 0)
            pieces[p] = first_of[n, p] + cut[n][1]
    classes, tail_at = {}, 0
    for p in sorted(pieces, reverse=True):
        whole = pieces[p] // (window // p) * (window // p)
        classes[p] = (sequence, whole, tail_at)
        sequence += pieces[p] // (window // p)
        tail_at += (pieces[p] - whole) * p
    return {"segments": segments, "cut": cut, "first_of": first_of, "classes": classes, "tail": sequence, "window": window, "sequences": sequence + -(-tail_at // window)}


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece."""
    spark = docs.sparkSession
    rows = stored(tokenized(docs, path, window, end_id), "packing")
    counts = rows.groupBy("rest", "part").agg(F.count("*").alias("n"))
    counts = stored(counts, "packing-counts")
    histogram = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # window entries at most
    made = plan(histogram, window, slack)
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("rest", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    segments = np.array(sorted(made["segments"]), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast((segments, {k: v for k, v in made.items() if k != "segments"}))  # window entries at most

    def assign(batches):
        seg, rest_of = shared.value
        keys = seg[:, 0] << 44 | seg[:, 1]
        cut, first_of, classes = rest_of["cut"], rest_of["first_of"], rest_of["classes"]
        for batch in batches:
            out = []
            c = {k: batch.column(k).to_pylist() for k in batch.schema.names}
            spots = np.searchsorted(keys, np.array([(n << 44) | (r + b) for n, r, b in zip(c["rest"], c["rank"], c["base"], strict=True)], np.int64), side="right") - 1
            for i, doc in enumerate(c["id"]):
                size, n, full = c["doc_tokens"][i], c["rest"][i], c["full_crcs"][i]
                for j, crc in enumerate(full):
                    out.append((doc, j * window, window, crc, size, FULL_BASE + (c["part"][i] << 28) + c["full_rank"][i] + j, 0))
                if not n:
                    continue
                rank, start = c["rank"][i] + c["base"][i], len(full) * window
                if n in cut and rank >= cut[n][0]:
                    for p, crc in zip(powers(n), c["power_crcs"][i], strict=True):
                        at = first_of[n, p] + rank - cut[n][0]
                        first, whole, tail_at = classes[p]
                        if at < whole:
                            place = (first + at // (window // p), at % (window // p) * p)
                        else:
                            at = tail_at + (at - whole) * p
                            place = (rest_of["tail"] + at // window, at % window)
                        out.append((doc, start, p, crc, size, *place))
                        start += p
                else:
                    _, first_rank, _, sequence, copies, offset = seg[spots[i]].tolist()
                    at = rank - first_rank
                    out.append((doc, start, n, c["rest_crc"][i], size, sequence + at // copies, offset + at % copies * n))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows.join(bases.hint("merge"), ["rest", "part"]).mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
