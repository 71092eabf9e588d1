"""Greedy word-piece lengths by a linear longest-match automaton.

A text's white-space words (space, \\x09-\\x0D), each preceded by one space, are cut greedily into the longest pieces of
a byte vocabulary. The trie of the pieces has failure links and, for each node, the number of pieces popped when the
link is taken (Song et al. 2021), so a word's length is counted in one pass over its bytes and no piece is built.
A byte that isn't in the vocabulary is a piece of its own.

Null or empty text: 0. Null doc_id: kept. Repeated rows: one result row each. Very long texts: taken in pieces. Empty table:
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, map_batches, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose lengths a task remembers; beyond it the memory is emptied.
REMEMBERED = 200_000


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


class Automaton:
    def __init__(self, pieces: list[bytes]):
        self.edges: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            at = 0
            for b in piece:
                if b not in self.edges[at]:
                    self.edges[at][b] = len(self.edges)
                    self.edges.append({})
                    whole.append(False)
                at = self.edges[at][b]
            whole[at] = bool(piece)
        n = len(self.edges)
        self.fail, self.popped = [0] * n, [0] * n
        level = list(self.edges[0].values())
        for v in level:
            self.popped[v] = 1
        while level:
            deeper = []
            for u in level:
                for b, v in self.edges[u].items():
                    deeper.append(v)
                    if whole[v]:
                        self.popped[v] = 1
                        continue
                    z, count = self.fail[u], self.popped[u]
                    while b not in self.edges[z]:
                        count += self.popped[z]
                        z = self.fail[z]
                    self.fail[v], self.popped[v] = self.edges[z][b], count
            level = deeper

    def length(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        at = count = 0
        for b in word:
            while (to := edges[at].get(b)) is None:
                count += popped[at]
                at = fail[at]
            at = to
        while at:
            count += popped[at]
            at = fail[at]
        return count


class _Memory(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.length(b" " + word)
        if len(word) <= 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of docs (doc_id, text): one narrow pass. The vocabulary (its size bounds it) is read on the driver and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    memory: list[_Memory] = []

    def work(batch):
        if not memory:
            memory.append(_Memory(Automaton(shared.value)))
        length, n_words, n_tokens = memory[0].__getitem__, [], []
        for text in column_bytes(batch.column(1)):
            n = tokens = 0
            for piece in pieces(text):
                words = piece.split()
                n, tokens = n + len(words), tokens + sum(map(length, words))
            n_words.append(n)
            n_tokens.append(tokens)
        return {"doc_id": batch.column(0), "n_words": n_words, "n_tokens": n_tokens}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n_words long, n_tokens long")
