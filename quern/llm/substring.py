"""Substring dedup by word windows, with a count-min prefilter.

Documents are dealt into groups of a few megabytes. First pass: each group sketches its windows, `depth` rows of cells; a
sketch is kept as its sorted cells, packed, and cut into blocks of cells. Blocks of all groups are merged: a cell that two
documents touch is repeated, whatever touched it, so counts are overestimated and never missed. Each group gets back one
bit per cell it touched. Second pass: windows whose cells are repeated in every row are grouped exactly, by the 128-bit
XXH3 digest of their words' own bytes; each group sends one record per value with its first document, and gets back one bit: whether
another group has an earlier one. The last pass removes words.

Sketch and records are sharded over the cluster and grow with the corpus, so the share of windows estimated repeated by
chance stays the same at every size; nothing is broadcast or collected. A passage that a third of all documents share makes
one record per group of documents, not per document.

A window belongs to one document; windows of a document do not count against itself. A null text is empty: no words.
A null doc_id counts as the largest number there is, and so is earlier than none; rows that share a doc_id are no duplicates of
each other. Texts of fewer words than a window keep everything; very long ones are one document of their group. An
empty table gives no rows, and other columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import GROUP_BYTES, bits_of, covered, grouped, mix, pack_cells, rolling, rows, stage, unpack_cells

WINDOW = 13
DEPTH = 2
#: Cells of a sketch row for each window of the corpus (words are taken to have 4 bytes at least).
CELLS_PER_WINDOW = 8
#: Windows that a block of cells, or a bucket of records, gets on average.
BLOCK_WINDOWS = 1_500_000
NO_ID = np.int64(2**63 - 1)
#: Words of up to LONGEST bytes whose hashes a worker remembers before it starts anew.
REMEMBERED, LONGEST = 1_000_000, 64


class _Hashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


#: One a Python worker, which serves one task at a time.
_hashes = _Hashes()


class Group:
    """The windows of one group of documents, in an order that depends on ids and texts only."""

    def __init__(self, docs: pa.Table, window: int = WINDOW):
        names = docs.column("doc_id").to_pylist()
        ids = [NO_ID if i is None else i for i in names]
        texts = [t or "" for t in docs.column("text").to_pylist()]
        self.window, self.order = window, sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.names = [names[k] for k in self.order]
        self.ids = np.array([ids[k] for k in self.order], np.int64)
        self.words = [texts[k].encode().split() for k in self.order]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.first = np.concatenate(([0], np.cumsum(counts)))  # of each document, in the group's words
        h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(self.words)), np.uint64, int(self.first[-1]))
        n = np.maximum(counts - window + 1, 0)
        self.doc = np.repeat(np.arange(len(counts)), n)
        self.at = np.arange(len(self.doc)) + np.repeat(self.first[:-1] - (np.cumsum(n) - n), n)  # first word of each window
        self.h1 = mix(rolling(h, window)[self.at]) if len(self.at) else h[:0]

    def cells(self, row: int, width: int) -> np.ndarray:
        return mix(self.h1, row + 3) % np.uint64(width)

    def digests(self, windows: np.ndarray) -> np.ndarray:
        """The two halves of the digest of some windows' words, joined by blanks."""
        import xxhash

        digest, out = xxhash.xxh3_128_digest, []
        doc, at = self.doc[windows], self.at[windows]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)])).tolist() if len(doc) else [0]
        for a, b in zip(edges, edges[1:]):  # windows come by document
            words = self.words[doc[a]]
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            first = at[a:b] - self.first[doc[a]]
            starts = np.where(first > 0, ends[first - 1] + 1, 0)
            out += [digest(line[x:y]) for x, y in zip(starts.tolist(), ends[first + self.window - 1].tolist())]
        return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)


def _touched(cells: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells in order, and which of them several documents touch. doc: of each cell, not falling."""
    if not len(cells):
        return cells, np.zeros(0, bool)
    _, rank = np.unique(doc, return_inverse=True)
    bits = int(rank[-1]).bit_length()
    if int(cells.max()).bit_length() + bits > 64:
        order = np.lexsort((rank, cells))
        cells, rank = cells[order], rank[order]
    else:  # both fit in one number, which sorts faster than an order is found
        both = np.sort(cells << np.uint64(bits) | rank.astype(np.uint64))
        cells, rank = both >> np.uint64(bits), both & np.uint64((1 << bits) - 1)
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    return cells[starts], rank[starts] != rank[np.append(starts[1:], len(cells)) - 1]


def _sketch(window: int, depth: int, width: int, block: int):
    """A row per (sketch row, block): this group's cells, and which of them several of its documents touch."""
    schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("g", pa.int32()), ("cells", pa.binary()), ("several", pa.binary())])

    def run(key, docs):
        group = Group(docs, window)
        out: list[list] = [[] for _ in range(5)]
        for row in range(depth):
            cells, several = _touched(group.cells(row, width), group.doc)
            blocks = (cells // np.uint64(block)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)]):
                if b > a:
                    for to, x in zip(out, (row, blocks[a], key[0].as_py(), pack_cells(cells[a:b] - np.uint64(int(blocks[a]) * block)), np.packbits(several[a:b]).tobytes())):
                        to.append(x)
        return rows(out, schema)

    return run


REPLY = pa.schema([("g", pa.int32()), ("row", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])
RECORDS = -1  # the row of replies about records


def _merge_cells(table: pa.Table) -> pa.Table:
    """One block of one sketch row, of all groups: for each group, which of its cells are repeated."""
    parts = [unpack_cells(x.as_py()) for x in table.column("cells")]
    several = np.concatenate([bits_of(x.as_py(), len(p)) for x, p in zip(table.column("several"), parts)])
    cells = np.concatenate(parts)
    found = np.sort(cells)
    twice = np.unique(np.concatenate((found[1:][found[1:] == found[:-1]], cells[several])))
    hit = np.append(twice, np.uint64(2**64 - 1))[np.searchsorted(twice, cells)] == cells
    bits = [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum([len(p) for p in parts])[:-1])]
    return rows([table.column(c).to_pylist() for c in ("g", "row", "block")] + [bits], REPLY)


def _repeated(group: Group, replies: list[dict], depth: int, width: int, block: int) -> np.ndarray:
    """Flags of the windows that the sketch estimates repeated."""
    out = np.ones(len(group.h1), bool)
    for row in range(depth):
        own = group.cells(row, width)
        cells = np.sort(own)
        cells = cells[np.concatenate(([True], cells[1:] != cells[:-1]))[: len(cells)]]
        flags, blocks = np.zeros(len(cells), bool), cells // np.uint64(block)
        for r in replies:
            if r["row"] == row:
                a, b = np.searchsorted(blocks, [r["block"], r["block"] + 1])
                flags[a:b] = bits_of(r["bits"], b - a)
        hit, left = cells[flags], np.flatnonzero(out)
        if not len(hit):
            return np.zeros(len(out), bool)
        some = own[left]
        out[left] = hit[np.minimum(np.searchsorted(hit, some), len(hit) - 1)] == some
    return out


class Records:
    """The distinct values among the flagged windows of a group, by bucket, each with its first document."""

    def __init__(self, group: Group, flags: np.ndarray, buckets: int):
        self.windows = np.flatnonzero(flags)
        halves, ids = group.digests(self.windows), group.ids[group.doc[self.windows]]
        h1, h2 = halves[:, 0], halves[:, 1]
        bucket = h1 % np.uint64(buckets)
        order = np.lexsort((ids, h2, h1, bucket))
        self.windows, h1, h2, ids, bucket = self.windows[order], h1[order], h2[order], ids[order], bucket[order]
        head = np.ones(len(order), bool)
        head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        self.number = np.cumsum(head) - 1  # of each window's record
        self.own = ids
        self.h1, self.h2, self.ids, self.bucket = h1[head], h2[head], ids[head], bucket[head].astype(np.int64)

    def parts(self):
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        return [(int(self.bucket[a]), a, b) for a, b in zip([0, *cuts], [*cuts, len(self.bucket)]) if b > a]


def _records(window: int, depth: int, width: int, block: int, buckets: int):
    schema = pa.schema([("block", pa.int32()), ("g", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("ids", pa.binary())])

    def run(key, docs, replies):
        group = Group(docs, window)
        r = Records(group, _repeated(group, replies.to_pylist(), depth, width, block), buckets)
        parts = r.parts()
        return rows([[k for k, _, _ in parts], [key[0].as_py()] * len(parts), *([x[a:b].tobytes() for _, a, b in parts] for x in (r.h1, r.h2, r.ids))], schema)

    return run


def _merge_records(table: pa.Table) -> pa.Table:
    """One bucket of records: for each, whether another group has the value in an earlier document."""
    h1, h2, ids = ([np.frombuffer(x.as_py(), kind) for x in table.column(c)] for c, kind in (("h1", np.uint64), ("h2", np.uint64), ("ids", np.int64)))
    sizes = [len(x) for x in ids]
    h1, h2, ids = np.concatenate(h1), np.concatenate(h2), np.concatenate(ids)
    order = np.lexsort((ids, h2, h1))
    head = np.ones(len(order), bool)
    head[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    earlier = np.empty(len(order), bool)
    earlier[order] = ids[order] > ids[order][head][np.cumsum(head) - 1]
    bits = [np.packbits(x).tobytes() for x in np.split(earlier, np.cumsum(sizes)[:-1])]
    return rows([table.column("g").to_pylist(), [RECORDS] * len(sizes), table.column("block").to_pylist(), bits], REPLY)


def _remove(window: int, depth: int, width: int, block: int, buckets: int, texts: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(key, docs, replies):
        group, said = Group(docs, window), replies.to_pylist()
        r = Records(group, _repeated(group, said, depth, width, block), buckets)
        earlier = np.zeros(len(r.ids), bool)
        answer = {x["block"]: x["bits"] for x in said if x["row"] == RECORDS}
        for k, a, b in r.parts():
            earlier[a:b] = bits_of(answer[k], b - a)
        cut = (earlier[r.number] | (r.own > r.ids[r.number])) if len(r.own) else np.zeros(0, bool)
        gone = covered(group.at[r.windows[cut]], window, int(group.first[-1]))
        out: list[list] = [[] for _ in range(5)]
        for k, words in enumerate(group.words):
            flags = gone[group.first[k] : group.first[k + 1]]
            n = int(flags.sum())
            kept = b" ".join([w for w, f in zip(words, flags.tolist()) if not f] if n else words)
            for to, x in zip(out, (group.names[k], len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None)):
                to.append(x)
        return rows(out, schema)

    return run


def _whole(texts: bool):
    """Texts without a window, as they are."""

    def run(batches):
        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            kept = [b" ".join(w) for w in words]
            out = [[len(w) for w in words], [0] * len(words), [hashlib.sha256(k).hexdigest() for k in kept], [k.decode() if texts else None for k in kept]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, group_bytes: int = GROUP_BYTES, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) per row of (doc_id, text): without each word that a window covers
    whose words also start in a document with a smaller doc_id. `kept` joins the words by blanks (null if not texts)."""
    base, short, groups, size = grouped(docs, 2 * window - 1, group_bytes)
    windows = max(1, size // 5)
    width = 1 << (CELLS_PER_WINDOW * windows - 1).bit_length()
    blocks = max(16, -(-windows // BLOCK_WINDOWS))
    block = -(-width // blocks)
    shape = (window, depth, width, block)
    sketch = base.groupBy("g").applyInArrow(_sketch(*shape), "row int, block int, g int, cells binary, several binary")
    reply = "g int, row int, block int, bits binary"
    cells = stage(sketch.groupBy("row", "block").applyInArrow(_merge_cells, reply), "sketch")
    records = base.groupBy("g").cogroup(cells.groupBy("g")).applyInArrow(_records(*shape, blocks), "block int, g int, h1 binary, h2 binary, ids binary")
    found = records.groupBy("block").applyInArrow(_merge_records, reply)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    made = base.groupBy("g").cogroup(cells.unionByName(found).groupBy("g")).applyInArrow(_remove(*shape, blocks, texts), out)
    return made.unionByName(short.mapInArrow(_whole(texts), out))
