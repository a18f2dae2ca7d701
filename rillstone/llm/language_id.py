"""Language identification with language-bitmask n-gram filters [free style].

Words are runs of letters (Unicode category L) with the marks that belong to them; numbers of any kind are no letters.

Training: letter n-grams of padded lower-case words are counted by language over the labelled rows. A gram belongs to a
language if its rate there is at least ``share`` of its highest rate in any language, so grams that strayed into a
language through mislabelled rows stay out. The (gram, language) pairs fill bit-sliced Bloom filters: one array of machine
words whose bit i is the filter of language i, so a few reads ANDed together give the mask of all languages that hold a gram.

Prediction: popcounts by language over the text's grams, each corrected for the false positives that its filter's measured
fill makes likely: (hits - n * fp) / (1 - fp). The largest corrected count decides (ties: the first by name); its share of the languages' corrected counts is the score.

The classifier may be fitted on a bounded sample: at most about ``train_rows`` labelled rows a language, chosen by a hash of
the id (all rows where there are fewer). Everything else covers whole texts of all rows.

Defined results: text null or without a letter: ``und``, score 0. No labelled row at all: ``und`` for all. A null id is never
held out and never trains. Repeated rows give repeated results; texts are never cut; an empty table gives no rows; other
columns are ignored, or kept by ``predict`` whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkTable, map_text, mix64, table

#: Bound on the sample that the filters are fitted on, by language (in expectation).
TRAIN_ROWS = 4000
ORDERS = (1, 2, 3, 4)
SHARE = 0.4
#: Least positions of the filters; a power of two. Eight positions for a pair at four probes keep false positives below 3 %, so
#: filters have eight at least for each gram of the language that has the most.
SLOTS = 1 << 21
PROBES = 4
#: Words whose grams are looked up at once.
BLOCK = 20_000
#: Prediction: bytes of text handled at once, and distinct words held: with more, the two workers of an executor leave too little room.
SLICE_BYTES, TABLE_WORDS = 1_000_000, 200_000
#: Exact in texts that hold none of ODD, and much faster there.
WORD = re.compile(r"[^\W\d_]+")
EXACT = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def _class(*categories: str) -> str:
    """The characters of the first plane that are of some categories, as ranges of a pattern."""
    out: list[list[int]] = []
    for c in range(0x10000):
        if unicodedata.category(chr(c)).startswith(categories):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


#: Marks, numbers other than digits, and what lies beyond the first plane: texts with these are read by EXACT.
ODD = re.compile(f"[{_class('M', 'Nl', 'No')}]")
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def gram_hashes(words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the hashes at all positions of the joined words, and where each word's own grams begin and end there.
    Words are padded by a blank on both sides; single letters leave the padding out."""
    codes = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    out = []
    for n in ORDERS:
        h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(h) + k]
        begin = starts + (n == 1)
        out.append((mix64(h), begin, np.maximum(begin, starts + lengths + 1 if n == 1 else starts + lengths + 3 - n)))
    return out


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return (EXACT if ODD.search(low) or BEYOND.search(low) else WORD).findall(low)


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over rows (lang, text): distinct words are counted in each slice, their grams weighted by that, and the
    counts added across tasks."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            seen = Counter(chain.from_iterable(words_of(t) for t, of in zip(texts, langs, strict=True) if of == lang))
            times = np.fromiter(seen.values(), np.int64, len(seen))
            for h, begin, end in gram_hashes(list(seen)):  # grams of different orders never meet
                sizes = end - begin
                ends = np.cumsum(sizes)
                gram, at = np.unique(h[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], return_inverse=True)
                n = np.bincount(at, np.repeat(times, sizes), len(gram)).astype(np.int64)
                out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]))
        return pa.concat_batches(out)

    counted = map_text(rows, "text", one, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Bit-sliced Bloom filters of all languages."""

    def __init__(self, languages: list[str], slots: int = SLOTS):
        self.languages = languages
        self.slots = slots
        self.kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * t().itemsize), np.uint64)  # no wider than the languages need
        self.bits = np.zeros((-(-len(languages) // 64) or 1, slots), self.kind)

    def places(self, grams: np.ndarray) -> list[np.ndarray]:
        step = (grams >> np.uint64(32)) | np.uint64(1)
        return [((grams + np.uint64(k) * step) & np.uint64(self.slots - 1)).astype(np.int64) for k in range(PROBES)]

    def add(self, language: int, grams: np.ndarray) -> None:
        for at in self.places(grams):
            self.bits[language // 64, at] |= self.kind(1 << language % 64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        places = self.places(grams)
        out = self.bits[:, places[0]]
        for at in places[1:]:
            out &= self.bits[:, at]
        return out

    def hits(self, masks: np.ndarray) -> np.ndarray:
        """A row for each gram, a column for each language."""
        return np.stack([(masks[i // 64] >> self.kind(i % 64)) & self.kind(1) for i in range(len(self.languages))], 1).astype(np.int32)

    def false_rates(self) -> np.ndarray:
        fill = [int(np.bitwise_count(self.bits[i // 64] & self.kind(1 << i % 64)).sum()) / self.slots for i in range(len(self.languages))]
        return np.array(fill) ** PROBES


def fit(rows: DataFrame, train_rows: int = TRAIN_ROWS, share: float = SHARE) -> Filters:
    """Filters from rows (id, lang, text); rows without language or text are left out. All grams of the sample that belong to a
    language are kept; they reach the driver by language."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return Filters([])
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, train_rows / n))])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20)).select("lang", "text")
    counts = count_grams(drawn).where("n >= 2")
    counts.persist()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    weight = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, 1.0 / n)]) if totals else F.lit(None)
    rated = counts.withColumn("rate", F.col("n") * weight[F.col("lang")]) if totals else counts.withColumn("rate", F.lit(0.0))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rated.join(best, "gram").where(F.col("rate") >= share * F.col("best")).select("lang", "gram")
    kept.persist()
    most = kept.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    filters = Filters(languages, max(SLOTS, 1 << (8 * most - 1).bit_length() if most else 0))
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    found = kept.select("gram", number[F.col("lang")].cast("int").alias("i")).toArrow()  # grams of the bounded sample, in one job
    grams, own = found.column("gram").to_numpy().view(np.uint64), found.column("i").to_numpy()
    for i in range(len(languages)):
        filters.add(i, grams[own == i])
    kept.unpersist()
    counts.unpersist()
    return filters


def predict(docs: DataFrame, filters: Filters, columns: list[str], text_col: str = "text", replace_text: bool = False) -> DataFrame:
    """The given columns of docs with lang_pred and score added. replace_text: the text is among the columns."""
    kept = [c for c in columns if replace_text or c != text_col]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    names = [f"c{i}" for i in range(len(kept))]  # by position, so that no name can clash
    text = names[kept.index(text_col)] if text_col in kept else "text"  # a kept text is not sent twice
    more = [] if text in names else [F.col(text_col).alias(text)]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], *more)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS words for each 64 languages, bytes for up to 8
    k = len(filters.languages)
    langs = np.array([*filters.languages, "und"], object)
    rates = filters.false_rates() if k else np.zeros(0)

    def setup():
        f = shared.value

        def encode(words):
            """For each word its number of grams and how many of them each language holds."""
            total = np.zeros((len(words), k + 1), np.int32)
            for i in range(0, len(words), BLOCK):
                part = total[i : i + BLOCK]
                for h, begin, end in gram_hashes(words[i : i + BLOCK]):
                    part[:, 0] += end - begin
                    sums = np.zeros((len(h) + 1, k), np.int32)
                    np.cumsum(f.hits(f.masks(h)), axis=0, out=sums[1:])
                    part[:, 1:] += sums[end] - sums[begin]
            return total

        return ChunkTable(encode, np.int32, TABLE_WORDS)

    def one(batch: pa.RecordBatch, chunks: ChunkTable) -> pa.RecordBatch:
        texts = batch.column(text).to_pylist()
        lists = [words_of(t) for t in texts] if k else [[] for _ in texts]
        del texts
        lengths = [len(x) for x in lists]
        at = chunks.lookup(list(chain.from_iterable(lists))) if k else np.zeros(0, np.int64)
        del lists
        best, score = np.full(len(lengths), k), np.zeros(len(lengths))
        if len(at):
            values = chunks.flat.reshape(-1, k + 1)
            ends = np.cumsum([0, *lengths])
            got = np.zeros((len(lengths), k + 1), np.int64)
            for i in range(k + 1):  # one column at a time: words are many, languages few
                sums = np.concatenate([[0], np.cumsum(values[at, i], dtype=np.int64)])
                got[:, i] = sums[ends[1:]] - sums[ends[:-1]]
            n = got[:, :1]
            fixed = np.maximum(0, (got[:, 1:] - n * rates) / (1 - rates))
            total = fixed.sum(axis=1)
            some = n[:, 0] > 0
            best = np.where(some, fixed.argmax(axis=1), k)
            score = np.where(some & (total > 0), fixed.max(axis=1) / np.maximum(total, 1e-300), 0.0)
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(langs[best].tolist(), pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema, strict=True))
    return map_text(rows, text, one, f"{fields}, lang_pred string, score double", setup, SLICE_BYTES).toDF(*kept, "lang_pred", "score")


def held_out(id_col):
    """Whether CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "lang", "text")
    filters = fit(rows.where(~held_out(F.col("id"))), **settings)
    out = predict(rows.select("id", held_out(F.col("id")).alias("held_out"), "text"), filters, ["id", "held_out"])
    return out.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
