"""Quality rules as a bitmask ledger [free style].

``ledger`` evaluates every rule once for each document and stores the measurements and one bit for each failed rule.
``apply_policy`` turns a ledger into verdicts for a versioned policy (a mask of the rules that count), ``ablations`` tells by
bitwise aggregation what each rule of a policy removes alone, first and together with others. Changing a policy or studying
an ablation reads the ledger only, never the texts.

Defined results: null or empty text has no words: all measures are 0, it fails ``too_few_words`` and is not kept; texts are
measured whole; repeated rows get equal rows in the ledger; extra columns are ignored, whatever their
names; rows without id keep a row; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ordinals, map_text, table, text_rows

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: The bit of each rule, in order. Rules are only ever appended, so stored ledgers keep their meaning.
RULES = ("too_few_words", "repeated_words", "symbol_words", "repeated_lines", "long_words", "short_words", "shouting")
#: Masks of the rules that count, by version.
POLICIES = {
    1: ("too_few_words", "repeated_words"),
    2: ("too_few_words", "repeated_words", "symbol_words", "repeated_lines", "long_words", "short_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def mask_of(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def repeat_words(words: np.ndarray) -> int:
    """Positions covered by three-word windows that are found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    # dense numbers of two-word windows, then of three-word windows: exact at any vocabulary size
    _, pairs = np.unique(words[:-1] << 32 | words[1:], return_inverse=True)
    _, at, times = np.unique(pairs[:-1] << 32 | words[2:], return_inverse=True, return_counts=True)
    twice = times[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text in batch.column("text").to_pylist():
        raw = (text or "").encode()
        words = raw.split()
        n = len(words)
        # code points in words: all bytes of words that don't continue a character
        joined = np.frombuffer(b"".join(words), np.uint8)
        chars = int(((joined & 0xC0) != 0x80).sum())
        lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else [raw] * bool(n)
        ids = Ordinals().of(words)
        upper = int(((joined >= 65) & (joined <= 90)).sum())
        rows.append((n, chars, len(SYMBOLS.findall(text or "")), len(lines) - len(set(lines)), repeat_words(ids), len(lines), upper))
    cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("id"), *cols], ["doc_id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measures, failed): one pass over the texts, no shuffle."""
    m = map_text(text_rows(docs, id_col, text_col), "text", measure, "doc_id long, " + ", ".join(f"{c} long" for c in MEASURES))
    n = F.col("n_words")
    tests = {
        "too_few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "symbol_words": 10 * F.col("n_symbols") > n,
        "repeated_lines": (F.col("n_lines") >= 5) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "long_words": F.col("word_chars") > 15 * n,
        "short_words": F.col("word_chars") < 2 * n,
        "shouting": 10 * F.col("n_upper") > 6 * F.col("word_chars"),
    }
    failed = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(tests[rule], F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return m.withColumn("failed", failed)


def apply_policy(rows: DataFrame, version: int) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0)


def ablations(rows: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: documents it fails, fails alone, and would be kept without it. One aggregation."""
    mask = mask_of(POLICIES[version])
    bits = F.col("failed").bitwiseAND(F.lit(mask))
    by_mask = rows.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))  # 2 ** rules groups at most
    out = []
    for rule in POLICIES[version]:
        bit = 1 << RULES.index(rule)
        out.append(F.struct(F.lit(rule).alias("rule"), F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("n_only"), F.sum(F.when(F.col("bits").bitwiseAND(F.lit(mask & ~bit)) == 0, F.col("n")).otherwise(0)).alias("n_kept_without")))
    return by_mask.agg(F.array(*out).alias("a")).select(F.inline("a"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), 2)
    base = F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[1]))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")
