"""SentencePiece encoding and decoding through a table of distinct chunks [free style].

A chunk is a run of whitespace markers with the word after it. No piece of the model holds a marker after another character
or a line feed beside another character (checked when the model is loaded), so no merge can cross a chunk border: every
distinct chunk is segmented once by the library and its ids are joined back by position. Where a model has such a piece, the
whole text is given to the library instead. Decoding goes by the same table, as bytes of one character never span chunks.

Defined results: null text counts as empty; an empty text gives begin and end ids only and decodes to the empty string;
texts of any length are handled whole; repeated rows give repeated results; rows without id keep
a row; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ChunkTable, map_text, table, text_rows

MARK = "▁"
CHUNK = re.compile(f"\n|[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+")


class Codec:
    """Encodes and decodes with one model file."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        ids = self.sp.encode("\n")
        self.mark, self.feed = self.sp.piece_to_id(MARK), ids[-1]
        self.by_chunk = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and len(ids) == 2 and ids[0] == self.mark and self.sp.decode(self.sp.encode(" a  b ")) == " a  b "
        self.table = ChunkTable(self._encode, np.uint32)
        self.decoded: list[str] = []

    def _encode(self, chunks: list[str]) -> list:
        """One library call for all new chunks: line feeds between them keep them apart, and their id marks where to cut."""
        if not len(self.table.starts):
            self.decoded = []
        words = [c for c in chunks if c != "\n"]
        ids = self.sp.encode("\n" + "\n".join(words), num_threads=1)
        texts = self.sp.decode(ids).split("\n")[1:]
        flat = np.array(ids, np.uint32)
        cuts = np.append(np.flatnonzero(flat == self.feed), len(flat))
        parts = iter([flat[a + 1 : b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
        texts_at = iter(texts)
        out = []
        for c in chunks:
            out.append(np.array([self.feed], np.uint32) if c == "\n" else next(parts))
            self.decoded.append("\n" if c == "\n" else next(texts_at))
        return out

    def run(self, texts: list) -> tuple[list[np.ndarray], list[str]]:
        """For each text all ids, begin and end included, and the decoded text."""
        bos, eos = np.array([self.sp.bos_id()], np.uint32), np.array([self.sp.eos_id()], np.uint32)
        if not self.by_chunk:
            ids = self.sp.encode([t or "" for t in texts], add_bos=True, add_eos=True, num_threads=1)
            return [np.array(i, np.uint32) for i in ids], self.sp.decode(ids)
        chunks = [CHUNK.findall(" " + t) if t else [] for t in texts]
        at = self.table.lookup(list(chain.from_iterable(chunks)))
        ids = self.table.gather(at)
        ends = np.cumsum([0, *map(len, chunks)])
        id_ends = np.concatenate([[0], np.cumsum(self.table.lengths[at])])[ends]
        words = list(map(self.decoded.__getitem__, at.tolist()))
        return [np.concatenate([bos, ids[a:b], eos]) for a, b in zip(id_ends[:-1], id_ends[1:])], ["".join(words[a:b])[1:] for a, b in zip(ends[:-1], ends[1:])]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row; one map over the rows, no shuffle."""

    def one(batch: pa.RecordBatch, codec: Codec) -> pa.RecordBatch:
        ids, decoded = codec.run(batch.column("text").to_pylist())
        offsets = np.cumsum([0, *map(len, ids)])
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return map_text(text_rows(docs, id_col, text_col), "text", one, "doc_id long, ids array<int>, decoded string", lambda: Codec(model))


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The codec's ids and decoded texts as counts and SHA-256 digests, taken where they are made so that no ids are moved."""

    def one(batch: pa.RecordBatch, codec: Codec) -> pa.RecordBatch:
        ids, decoded = codec.run(batch.column("text").to_pylist())
        n = list(map(len, ids))
        a = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
        b = [hashlib.sha256(d.encode()).hexdigest() for d in decoded]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_text(text_rows(docs, id_col, text_col), "text", one, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: Codec(model))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

