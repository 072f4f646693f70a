"""Best-fit packing: whole documents into sequences of at most `capacity` tokens, in bulk-synchronous rounds.

1. Tokens: a narrow map makes one row per piece (documents longer than the capacity are cut; the first piece holds the rest
   that is left over), with the ids' checksum; ids themselves are not kept. Each task numbers its pieces of a length, and
   counts by length and task make that number a rank among all pieces of the length, without a sort of pieces.
2. Rounds over a table of runs: documents (length, first rank, count), and gaps (room, first sequence, count).
   a. Documents not much shorter than the longest one left, and all gaps, are dealt into ranges of size; each range is sorted
      by falling size. Shorter documents wait, as they fit tighter when the longer ones have their places.
   b. A sweep down each range matches every document with its successor, the smallest gap that holds it and that no
      longer document holds; of one length the lesser rank goes first. A gap takes one run of documents a round, as
      many of a length as fit. What a range leaves over meets in a last sweep over all ranges.
   c. Matched gaps shrink to what remains and take part again in the next round, as do the documents that lost.
   d. Where no gap holds the longest documents, as many new sequences as these need at least join the gaps.
   The last task of a round also opens the next one, so a job can do ROUNDS of them before its table is written.
3. Pieces find their place by length and rank among the matched runs.

All pieces of one length are interchangeable, so rounds work on runs: at most `capacity` of documents, and a round adds at most
two runs of gaps a document run. The rounds' tables, and the matched runs that every task gets, depend on the
capacity and (by the logarithm, through the number of rounds) hardly on the corpus.

Nulls and empty texts are documents of one token, the end mark. Null ids and repeated rows are packed as rows of their own,
an empty table gives no rows, very long texts are cut, and other columns than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import rows, scope, stage

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Sizes of one range.
RANGE = 256


def _merger(path: str):
    """A function from a text to its ids that merges by rank, or None.

    Where the file's merges number its tokens in their own order, merging the pair of the least id first is what the
    tokenizers library does, and tiktoken's loop does it in a quarter of the time. Everything is read from the same file.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: the byte alphabet of byte-level BPE
    shown = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(letters))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)) or any(vocab.get(c, 256) > 255 for c in shown):
        return None
    ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
    return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy


#: Fixed value: the vocabulary's published pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Ids of whole texts, equal to the tokenizers library's with its own settings. Texts with a special token's name, those with
    characters from U+0250 on, which two libraries' Unicode tables could class differently, and vocabularies whose merges
    are not in rank order go to that library itself."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.named = re.compile("|".join(names)).search if names else lambda text: None
        self.exotic = re.compile("[^\x00-\u024f]").search
        self.merge = _merger(path)

    def __call__(self, text: str) -> np.ndarray:
        if self.merge is None or self.named(text) or (not text.isascii() and self.exotic(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.merge(text)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones, but for the first, which takes what is over."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece of each document's ids, the end mark included; task and number (from 0, among the task's pieces of one
    length) tell pieces apart. To be written before use: a task that runs again may number otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, task, seen = Encoder(vocabulary or vocabulary_path()), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("number", pa.int64())])
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(ids, texts):
                x = np.append(encoder(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                for k, (start, length) in enumerate(cut(len(x), capacity)):
                    for to, v in zip(out, (doc, k, start, length, zlib.crc32(x[start : start + length]), task, int(seen[length]))):
                        to.append(v)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + ", task int, number long")


# Kinds of rows in a round's table. GAP and DOC take part in the next sweep, SHRUNK gaps in the next round, and documents that
# WAIT when it is their turn. PLACED says where `n` pieces of length `size`, from rank `first` on, went: to sequences from
# `seq` on, all at one offset. NEXT has the number of sequences.
GAP, DOC, SHRUNK, WAITS, PLACED, NEXT = range(6)
RUNS = "kind int, size long, first long, n long, seq long, offset long"
_RUNS = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("size", "first", "n", "seq", "offset"))])
#: A round takes documents that are at least this part of the longest one left.
ADMITTED = (4, 5)
#: Rounds of one job, between two written tables.
ROUNDS = 8


def sweep(runs: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """One sweep over runs of gaps and documents by falling size. The gaps met so far are a stack, its top the smallest: the
    successor of the document at hand. Other kinds pass through."""
    out = [r for r in runs if r[0] not in (GAP, DOC)]
    open_: list[tuple[int, int, int]] = []
    for kind, size, first, n, *_ in sorted((r for r in runs if r[0] in (GAP, DOC)), key=lambda r: (-r[1], r[0], r[2])):
        if kind == GAP:
            open_.append((size, first, n))
            continue
        while n and open_:
            gap, seq, there = open_.pop()
            per = gap // size
            used = min(there, -(-n // per))
            if used < there:
                open_.append((gap, seq + used, there - used))
            layers = []
            for k in range(per):
                got = min(used, n)
                layers.append(got)
                if got:
                    out.append((PLACED, size, first, got, seq, capacity - gap + k * size))
                first, n = first + got, n - got
            for k, (a, b) in enumerate(zip(layers, [*layers[1:], 0])):  # sequences seq + b .. seq + a took k + 1 pieces
                if a > b and gap - (k + 1) * size:
                    out.append((SHRUNK, gap - (k + 1) * size, seq + b, a - b, 0, 0))
        if n:
            out.append((DOC, size, first, n, 0, 0))
    return out + [(GAP, *g, 0, 0) for g in open_]


def wanted(gaps: list[int], docs: dict[int, int], capacity: int = CAPACITY) -> int:
    """New sequences that documents (counts by size) longer than every gap need in any case: by their tokens, and by the number
    of those that cannot share a sequence."""
    unfit = {k: n for k, n in docs.items() if k > max(gaps, default=0)}
    return max(-(-sum(k * n for k, n in unfit.items()) // capacity), sum(n for k, n in unfit.items() if 2 * k > capacity))


def settle(runs: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """The next round's runs: gaps updated, documents admitted or told to wait, new sequences opened."""
    docs = {r[1]: r[3] for r in runs if r[0] in (DOC, WAITS)}  # of a length one run is left
    least = -(-max(docs, default=0) * ADMITTED[0] // ADMITTED[1])
    opened = sum(r[3] for r in runs if r[0] == NEXT)
    out = []
    for kind, *rest in runs:
        if kind in (DOC, WAITS):
            kind = DOC if rest[0] >= least else WAITS
        out.append((GAP if kind == SHRUNK else kind, *rest))
    if fresh := wanted([r[1] for r in out if r[0] == GAP], {k: n for k, n in docs.items() if k >= least}, capacity):
        out = [r for r in out if r[0] != NEXT] + [(GAP, capacity, opened, fresh, 0, 0), (NEXT, 0, 0, opened + fresh, 0, 0)]
    return out


def _step(*steps, capacity: int):
    def run(table: pa.Table) -> pa.Table:
        made = list(zip(*(table.column(c).to_pylist() for c in _RUNS.names)))
        for step in steps:
            made = step(made, capacity)
        return rows(list(zip(*made)) or [[]] * len(_RUNS), _RUNS)

    return run


def match(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of kind PLACED that give each piece of (length, n) a sequence; a written table."""
    zero = F.lit(0).cast("long")
    state = lengths.select(F.lit(DOC).alias("kind"), F.col("length").cast("long").alias("size"), zero.alias("first"), F.col("n").cast("long").alias("n"), zero.alias("seq"), zero.alias("offset"))
    state = state.groupBy().applyInArrow(_step(settle, capacity=capacity), RUNS)
    while True:
        for _ in range(ROUNDS):
            state = state.withColumn("range", F.floor(F.col("size") / RANGE)).groupBy("range").applyInArrow(_step(sweep, capacity=capacity), RUNS)
            state = state.groupBy().applyInArrow(_step(sweep, settle, capacity=capacity), RUNS)
        state = stage(state, "rounds")
        if state.where(F.col("kind").isin(DOC, WAITS)).isEmpty():
            return state.where(F.col("kind") == PLACED)


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of a written table that pieces() made."""
    with scope() as keep:
        sizes = keep(stage(made.groupBy("length", "task").agg(F.count("*").alias("n")), "sizes"))
        # runs depend on the capacity, not on the corpus: what is collected and goes to every task is some 10^4 rows
        plan = sorted(map(tuple, match(sizes.groupBy("length").agg(F.sum("n").alias("n")), capacity).select("size", "first", "seq", "offset").collect()))
    lengths, firsts, sequences, offsets = (np.array([r[i] for r in plan], np.int64) for i in range(4))
    keys = (lengths << 48) + firsts
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = made.join(starts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).cast("long").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequences[at] + rank - firsts[at]), pa.array(offsets[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack (doc_id, text): one row per piece with its sequence and its place there. vocabulary: the file's
    path on the executors; unset, each process asks the installed package for its own."""
    return pack(stage(pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
