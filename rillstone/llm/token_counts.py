"""Greedy word-piece token counts with a linear longest-match automaton [free style].

The vocabulary is a trie: pieces that start a word at one root, continuing pieces at another. Each node has a failure link
to the node of what remains after the pieces popped on the way, and the number of pieces popped. A word is read once,
character by character; on a mismatch the link is followed and the count grows, so lengths come out in linear time and no
piece is ever built. Each distinct word of a partition is read once; counts join back by position.

A word is a run of characters other than ASCII white space. A word that can't be segmented counts as one unknown token. The query
reads each word with the mark in front over the full vocabulary, so the mark alone is the first piece where no longer marked one
fits, and only words with a character outside the vocabulary are unknown.

Defined results: null or empty text: 0 words, 0 tokens; words of any length are read whole; repeated rows repeat; rows without
id keep a row; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ChunkTable, held, map_text, table, text_rows


class LongestMatch:
    """The automaton for a set of word-initial pieces and one of continuing pieces."""

    def __init__(self, initial: set[str], continuing: set[str]):
        self.step: list[dict[str, int]] = [{}, {}]
        self.piece = [False, False]
        parents: list[tuple[int, str]] = [(-1, ""), (-1, "")]
        for root, pieces in ((0, initial), (1, continuing)):
            for p in sorted(pieces):
                at = root
                for ch in p:
                    if ch not in self.step[at]:
                        self.step[at][ch] = len(self.step)
                        self.step.append({})
                        self.piece.append(False)
                        parents.append((at, ch))
                    at = self.step[at][ch]
                self.piece[at] = bool(p)
        self.fail = [-1] * len(self.step)
        self.popped = [0] * len(self.step)
        level = [n for root in (0, 1) for n in self.step[root].values()]
        while level:  # breadth first: links point to shallower nodes or to nodes of earlier levels
            following = []
            for v in level:
                if self.piece[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    u, ch = parents[v]
                    z, n = self.fail[u], self.popped[u]
                    while z != -1 and ch not in self.step[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z != -1:
                        self.fail[v], self.popped[v] = self.step[z][ch], n
                following += self.step[v].values()
            level = following

    def count(self, word: str) -> int:
        """Pieces of the greedy longest-match segmentation; -1 if there is none."""
        if not word:
            return 0
        step, fail, popped = self.step, self.fail, self.popped
        at, n = 0, 0
        for ch in word:
            while (to := step[at].get(ch)) is None:
                n += popped[at]
                at = fail[at]
                if at == -1:
                    return -1
            at = to
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at == -1:
                return -1
        return n


def automaton(model: str, bare_mark: bool = False) -> LongestMatch:
    """The automaton of a SentencePiece vocabulary: marked pieces start words, the others continue them. bare_mark: all pieces, for
    words with the mark in front."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if bare_mark:
        return LongestMatch({p for p in pieces if p[0] == "▁"}, set(pieces))
    return LongestMatch({p[1:] for p in pieces if p[0] == "▁" and "▁" not in p[1:] and len(p) > 1}, {p for p in pieces if "▁" not in p})


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", bare_mark: bool = False) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row; one map over the rows, no shuffle. bare_mark: the mark may be a piece."""
    mark = "▁" if bare_mark else ""

    def setup():
        auto = held(("automaton", model, bare_mark), lambda: automaton(model, bare_mark))

        def encode(words):
            n = np.array([auto.count(mark + w.decode()) for w in words], np.int32)
            return np.column_stack([np.where(n < 0, 1, n), n < 0]).astype(np.int32)

        return ChunkTable(encode, np.int32)

    def one(batch: pa.RecordBatch, chunks: ChunkTable) -> pa.RecordBatch:
        lists = [t.encode().split() if t else [] for t in batch.column("text").to_pylist()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        at = chunks.lookup([w for x in lists for w in x])
        values = chunks.flat.reshape(-1, 2)[at].astype(np.int64)
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(values, axis=0)])
        ends = np.cumsum(np.concatenate([[0], sizes]))
        got = sums[ends[1:]] - sums[ends[:-1]]
        return pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(x, pa.int64()) for x in (sizes, got[:, 0], got[:, 1])]], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return map_text(text_rows(docs, id_col, text_col), "text", one, "doc_id long, n_words long, n_tokens long, n_unknown long", setup)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), bare_mark=True)
