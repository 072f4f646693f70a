"""Token counts: greedy longest-match word pieces, counted by an automaton that reads each byte once.

The vocabulary is a trie over bytes. Each node has a failure link: the node reached after the longest match that fits is cut
off, and how many pieces that cuts, precomputed. Reading a word follows trie edges and failure links only, adds the
precomputed counts, and never builds a piece. A worker remembers the counts of words it has seen, so each distinct word runs
through the automaton once.

A word is a run of characters other than U+0020 and U+0009 to U+000D, read as its UTF-8 bytes with a blank before it, as the
byte-level vocabulary writes the begin of a word. Every byte is a token, so no word is unknown.
Nulls and texts without words have no words and no tokens; null ids and repeated rows pass through, an empty table gives no rows.
Very long texts and words are read whole, byte by byte. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Distinct words of up to LONGEST bytes whose counts a worker remembers before it starts anew.
REMEMBERED, LONGEST = 1_000_000, 64


def load_vocabulary(path: str) -> list[bytes]:
    """The tokens of a byte-level vocabulary file as bytes, special tokens left out."""
    import json

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: the byte alphabet of byte-level BPE
    shown = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(letters))}
    special = {t["content"] for t in data.get("added_tokens", [])}
    return [bytes(shown[c] for c in t) for t in data["model"]["vocab"] if t not in special]


class Automaton:
    """go: node * 256 + byte -> node; fail, popped: where a node goes when no edge fits, and how many pieces are cut then."""

    def __init__(self, vocabulary: list[bytes]):
        if missing := set(range(256)) - {t[0] for t in vocabulary if len(t) == 1}:
            raise ValueError(f"no token for the single bytes {sorted(missing)[:5]}")
        self.go: dict[int, int] = {}
        ends, parent, letter = [False], [0], [0]
        for token in vocabulary:
            at = 0
            for b in token:
                key = at * 256 + b
                at = self.go.get(key, -1)
                if at < 0:
                    at = self.go[key] = len(ends)
                    ends.append(False)
                    parent.append(key >> 8)
                    letter.append(b)
            ends[at] = True
        n = len(ends)
        self.fail, self.popped = [0] * n, [0] * n
        order, layer = [], [0]
        children: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            children[parent[v]].append(v)
        while layer:
            layer = [c for v in layer for c in children[v]]
            order += layer
        for v in order:
            if ends[v]:  # the whole string is a piece
                self.fail[v], self.popped[v] = 0, 1
                continue
            # cut as the parent would, until the letter fits behind what is left
            at, count = self.fail[parent[v]], self.popped[parent[v]]
            while (key := at * 256 + letter[v]) not in self.go:
                count += self.popped[at]
                at = self.fail[at]
            self.fail[v], self.popped[v] = self.go[key], count

    def count(self, word: bytes) -> int:
        go, fail, popped = self.go, self.fail, self.popped
        at = n = 0
        for b in word:
            to = go.get(at * 256 + b)
            while to is None:
                n += popped[at]
                at = fail[at]
                to = go.get(at * 256 + b)
            at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n


class Counts(dict):
    """word -> pieces of a blank and the word."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.count = automaton.count

    def __missing__(self, word: bytes) -> int:
        n = self.count(b" " + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def _counts(vocabulary: str | None) -> Counts:
    """Made once a Python worker, which serves many tasks."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    return Counts(Automaton(load_vocabulary(vocabulary)))


DIGEST = "doc_id long, n_words long, n_tokens long, max_word_tokens long"


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of (doc_id, text): words, word pieces, and the most pieces of one word. A narrow map. vocabulary: the
    file's path on the executors; unset, each process asks the installed package for its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _counts(vocabulary).__getitem__
        for batch in batches:
            per = [np.fromiter(map(get, words), np.int64, len(words)) for words in ((t or "").encode().split() for t in batch.column("text").to_pylist())]
            out = [[len(x) for x in per], [int(x.sum()) for x in per], [int(x.max(initial=0)) for x in per]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", "n_words", "n_tokens", "max_word_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)
