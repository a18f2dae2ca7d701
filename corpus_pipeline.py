"""Training-corpus pipeline over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last keep the columns of documents. Null texts count as empty; texts are read whole; repeated rows are copies of
one document, of which the near-duplicate stage keeps one. Rows without id and rows of equal id and different text are documents
of their own. An empty table passes through all stages as an empty one. Other columns are kept whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm import common, language_id, packing, pii, simhash, substring_dedup


def keep_known_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter go."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "lang", "text")
    filters = language_id.fit(rows.where(~language_id.held_out(F.col("id"))))
    return language_id.predict(docs, filters, docs.columns, replace_text=True).where("lang_pred <> 'und'").select(*docs.columns)


def keep_one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id; rows without id come after all others. Groups are
    of texts alone: rows without id and rows that share an id stay unless their texts are near-copies."""
    # the key stands for a whole row; a flag for nulls keeps a value from counting for its neighbour's
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.xxhash64(*[x for c in names for x in (c, c.isNull())]).alias("key"), "doc_id", "text")
    groups = simhash.near_groups(rows.select("doc_id", "text", F.col("key").alias("mark")), keep=("mark",))
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "mark")).alias("first"))
    kept = common.stored(first.select(F.col("first.mark").alias("key")), "pipeline-kept")
    # kept has no bound, so it is never broadcast: the plan is the same at every size
    rows = rows.select("row", "key").join(kept.hint("merge"), "key", "left_semi")
    again = common.stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "pipeline-again")
    once = rows.join(again.hint("merge"), "key", "left_anti").select("row")
    more = rows.join(again.hint("merge"), "key", "left_semi").select("row").distinct()
    return once.union(more).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def remove_repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that repeat; n_chars follows the text."""
    return substring_dedup.removed(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def redact_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_windows(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in windows of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_language),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("substring_dedup", remove_repeated_passages),
    ("pii", redact_personal_data),
    ("packing", pack_windows),
]

#: SQL can express neither the fitted language filters nor the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents, one after the other."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
