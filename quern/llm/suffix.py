"""Suffix-array dedup of byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Sharding. A string of `length` bytes is named by the least hash among its 32-byte grams, so equal strings have equal names.
Consecutive starts with one name make a segment: its text runs from the first start to the last one's end. Segments part
a document's starts. A sketch, merged in blocks over all groups of documents, tells each group which names several
segments have, or one that repeats itself; only those segments go on, each distinct text of a group once, to the shard of their name. Every two equal
strings meet in one shard, and the inside of a passage that a third of all documents share arrives once per group of documents.

Hot names. Where a common passage begins or ends, a segment holds some of its document's own text too, so one name has a
distinct segment per document. The sketch also adds up distinct segments, and of names with more than HOT_SEGMENTS
the strings go on one by one, as the 128-bit digest of their bytes with the first owner in the group, dealt by the digest; the
earliest owner of each is found by sorting. So neither a shard nor a bucket grows with the number of documents that share a passage.

In a shard, equal segments collapse to their earliest owner, those without a string whose hash occurs twice drop out, and the
others, in the order of their owners, are joined with separators. Suffixes are sorted by their first `length` symbols (prefix doubling stops there), which gives the transform.
Interval expansion then walks breadth first: from the interval of the empty string, each interval of a string w is
extended backwards by the symbols in its part of the transform; the end of a new interval of cw is a place where suffixes
part after exactly |w| symbols, and an end seen before is not walked again. So common prefixes are derived by increasing
value, and the walk stops at `length`: suffixes never parted share at least that much. Of each such class all but the
earliest start are repeats. Groups get one bit per start back and remove the covered bytes.

A null text is empty. A null doc_id counts as the largest number there is; rows that share an id are ordered by the hash of their
text, and equal rows count as copies of one another. Texts shorter than `length` keep everything; very long ones are one
document of their group. An empty table gives no rows, and other columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import GROUP_BYTES, bits_of, covered, grouped, mix, pack_cells, rolling, rows, spans_of, stage, unpack_cells
from .substring import NO_ID, RECORDS, REPLY, _repeated

LENGTH = 100
GRAM = 32
DEPTH = 2
#: Cells of a sketch row for each expected segment; bytes of text per expected segment.
CELLS_PER_SEGMENT = 16
SEGMENT_BYTES = 30
BLOCK_SEGMENTS = 500_000
#: Corpus bytes for each shard of segments.
SHARD_BYTES = 4_000_000
#: Distinct segments of one name from which its strings are told apart one by one.
HOT_SEGMENTS = 1500
#: Added to the row of a sketch reply: which of the cells are hot.
HOT = 1000

_TABLE = mix(np.arange(1, 257, dtype=np.uint64))


def sliding(best, x: np.ndarray, width: int) -> np.ndarray:
    """Least or greatest (best: np.minimum or np.maximum) of each `width` consecutive entries, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[: len(x) - step], x[step:])
        done += step
    return x


class Pieces:
    """The segments of one group of documents, in an order that depends on ids and texts only."""

    def __init__(self, docs: pa.Table, length: int = LENGTH, inner: bool = False):
        """inner: also tell which segments may repeat themselves, which only the sketch asks."""
        import xxhash

        names = docs.column("doc_id").to_pylist()
        ids = [NO_ID if i is None else i for i in names]
        texts = [(t or "").encode() for t in docs.column("text").to_pylist()]
        marks = [xxhash.xxh64_intdigest(t) for t in texts]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], marks[k]))
        self.names = [names[k] for k in order]
        self.ids, self.marks = np.array([ids[k] for k in order], np.int64), np.array([marks[k] for k in order], np.uint64)
        self.data = b"".join([texts[k] for k in order])
        self.first = np.concatenate(([0], np.cumsum([len(texts[k]) for k in order], dtype=np.int64)))
        self.length, n = length, len(self.data) - length + 1
        edge = np.zeros(max(n, 0) + 1, np.int32)
        long = np.diff(self.first) >= length
        np.add.at(edge, self.first[:-1][long], 1)
        np.add.at(edge, self.first[1:][long] - length + 1, -1)
        valid = np.cumsum(edge[:-1]) > 0
        gram = min(GRAM, length)
        grams = mix(rolling(_TABLE[np.frombuffer(self.data, np.uint8)], gram))
        name = sliding(np.minimum, grams, length - gram + 1) if n > 0 else np.zeros(0, np.uint64)
        new = np.ones(len(valid), bool)
        new[1:] = (name[1:] != name[:-1]) | ~valid[:-1]
        self.lo = np.flatnonzero(valid & new)
        last = np.ones(len(valid), bool)
        last[:-1] = (name[1:] != name[:-1]) | ~valid[1:]
        self.hi = np.flatnonzero(valid & last)
        self.h1 = name[self.lo]
        self.doc = np.searchsorted(self.first, self.lo, "right") - 1
        self.inner = np.isin(self.h1, self._inner(grams, name, length - gram + 1)) if inner and n > 0 else np.zeros(len(self.h1), bool)

    @staticmethod
    def _inner(grams: np.ndarray, name: np.ndarray, width: int) -> np.ndarray:
        """Names whose gram occurs twice within one reach: only a segment of such a name can hold equal strings in itself."""
        none = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(grams == sliding(np.maximum, np.concatenate((none, name, none)), width))
        order = np.argsort(grams[at], kind="stable")
        at, value = at[order], grams[at[order]]
        return np.unique(value[1:][(value[1:] == value[:-1]) & (np.diff(at) <= width)])

    def cells(self, row: int, width: int) -> np.ndarray:
        return mix(self.h1, row + 3) % np.uint64(width)

    def distinct(self, cell: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each cell the segments of distinct texts, given those of all segments, which only matter where there are many."""
        counts = np.minimum(counts, 65535).astype(np.uint16)
        many = np.flatnonzero(counts[cell] > 8)
        texts: dict[int, set[bytes]] = {}
        for c, a, b in zip(cell[many].tolist(), self.lo[many].tolist(), self.hi[many].tolist()):
            texts.setdefault(c, set()).add(self.data[a : b + self.length])
        for c, found in texts.items():
            counts[c] = min(len(found), 65535)
        return counts

    def candidates(self, flags: np.ndarray, hot: np.ndarray, shards: int) -> None:
        """Flagged segments: `rep` has those that come first with their text in this group, by shard; `copies` the others.
        Of hot ones `strings` has the starts, each with its digest (two halves), by bucket, and `head` those that come first."""
        import xxhash

        seen: set[bytes] = set()
        rep, copies, texts, data, length = [], [], [], self.data, self.length
        some = flags & ~hot
        for k, a, b in zip(np.flatnonzero(some).tolist(), self.lo[some].tolist(), self.hi[some].tolist()):
            text = data[a : b + length]
            if text in seen:
                copies.append(k)
            else:
                seen.add(text)
                rep.append(k)
                texts.append(text)
        shard = (mix(self.h1[rep], 7) % np.uint64(shards)).astype(np.int64) if rep else np.zeros(0, np.int64)
        order = np.argsort(shard, kind="stable")
        self.rep, self.copies, self.texts = np.array(rep, np.int64)[order], np.array(copies, np.int64), [texts[k] for k in order]
        self.shard = shard[order]
        at = self.starts(np.flatnonzero(flags & hot))
        digest = xxhash.xxh3_128_digest
        halves = np.frombuffer(b"".join([digest(data[a : a + length]) for a in at.tolist()]), np.uint64).reshape(-1, 2)
        bucket = (halves[:, 0] % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((at, halves[:, 1], halves[:, 0], bucket))
        self.strings, self.halves, self.bucket = at[order], halves[order], bucket[order]
        self.head = np.ones(len(order), bool)
        self.head[1:] = (self.halves[1:] != self.halves[:-1]).any(axis=1)

    def starts(self, segments: np.ndarray) -> np.ndarray:
        """All starts of some segments, one segment after another."""
        lo, n = self.lo[segments], (self.hi - self.lo + 1)[segments]
        return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)

    def buckets(self):
        """(bucket, from, to) among the strings that come first in this group."""
        bucket = self.bucket[self.head]
        cuts = (np.flatnonzero(np.diff(bucket)) + 1).tolist()
        return [(int(bucket[a]), a, b) for a, b in zip([0, *cuts], [*cuts, len(bucket)]) if b > a]

    def parts(self):
        cuts = (np.flatnonzero(np.diff(self.shard)) + 1).tolist()
        return [(int(self.shard[a]), a, b) for a, b in zip([0, *cuts], [*cuts, len(self.shard)]) if b > a]


def sort_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """Positions of `text` (symbols below 512) in the order of their first `length` symbols; equal ones in any order."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, text.dtype))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(9) | padded[k : n + k]
    order = np.argsort(key)
    head = np.ones(n, bool)
    head[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    done = 7
    while done < length:
        starts = np.flatnonzero(head)
        rank[order] = starts[np.cumsum(head) - 1]  # ties share the place of the first
        tied = ~head
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        some = order[at]
        behind = np.where(some + done < n, rank[np.minimum(some + done, n - 1)] + 1, 0)
        key = rank[some].astype(np.uint64) << np.uint64(32) | behind.astype(np.uint64)
        again = np.argsort(key)
        order[at] = some[again]
        key = key[again]
        head[at[1:]] |= key[1:] != key[:-1]
        done *= 2
    return order


#: An interval of the transform with fewer entries is read entry by entry, a longer one symbol by symbol.
SHORT = 48


def parted(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """parted[j]: the suffixes at places j - 1 and j of the order share fewer than `length` symbols. By interval expansion."""
    n = len(text)
    out = np.zeros(n + 1, bool)
    out[0] = out[n] = True
    bwt = text[order - 1].astype(np.int64)
    symbols, counts = np.unique(bwt, return_counts=True)
    base = dict(zip(symbols.tolist(), (np.cumsum(counts) - counts).tolist()))
    by_symbol = np.argsort(bwt, kind="stable")  # places by symbol: C[c] + rank
    back = np.empty(n, np.int64)  # of a place, the place of its suffix with the symbol before it
    back[by_symbol] = np.arange(n)
    places = {c: by_symbol[base[c] : base[c] + k] for c, k in zip(symbols.tolist(), counts.tolist())}
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        short = hi - lo < SHORT
        found_lo, found_hi = [], []
        if not short.all():
            a, b = lo[~short], hi[~short]
            for c, at in places.items():
                x, y = np.searchsorted(at, a), np.searchsorted(at, b)
                some = y > x
                found_lo.append(base[c] + x[some])
                found_hi.append(base[c] + y[some])
        a, sizes = lo[short], (hi - lo)[short]
        one = sizes == 1
        x = back[a[one]]
        found_lo.append(x)
        found_hi.append(x + 1)
        a, sizes = a[~one], sizes[~one]
        if len(a):
            ends = np.cumsum(sizes)
            which = np.repeat(np.arange(len(a)), sizes)
            at = np.arange(ends[-1]) + np.repeat(a - (ends - sizes), sizes)
            order2 = np.argsort(which << 9 | bwt[at], kind="stable")
            key, x = (which << 9 | bwt[at])[order2], back[at[order2]]
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            found_lo.append(x[head])
            found_hi.append(x[np.append(head[1:], len(x)) - 1] + 1)
        lo, hi = np.concatenate(found_lo), np.concatenate(found_hi)
        fresh = ~out[hi]
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
        out[hi] = True
    return out[:n]


def repeats(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For distinct segments in order, flags of the starts whose `length` bytes begin at an earlier start too."""
    sizes = np.array([len(s) for s in segments], np.int64)
    out = [np.zeros(n - length + 1, bool) for n in sizes.tolist()]
    some = np.flatnonzero(_suspects(segments, sizes, length))
    if not len(some):
        return out
    sizes = sizes[some]
    text = np.frombuffer(b"\0".join([segments[k] for k in some.tolist()]) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    order = sort_suffixes(text, length)
    cut = parted(text, order, length)
    heads = np.flatnonzero(cut)
    earliest = np.minimum.reduceat(order, heads)
    again = np.ones(len(text), bool)
    again[earliest] = False
    for k, a, n in zip(some.tolist(), (ends - sizes).tolist(), sizes.tolist()):
        out[k] = again[a : a + n - length + 1]
    return out


def _suspects(segments: list[bytes], sizes: np.ndarray, length: int) -> np.ndarray:
    """Segments that have a string whose hash occurs twice among all; the others have no repeat and need no transform."""
    h = mix(rolling(_TABLE[np.frombuffer(b"".join(segments), np.uint8)], length))
    n, first = sizes - length + 1, np.cumsum(sizes) - sizes
    own = h[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)]
    found = np.sort(own)
    twice = found[1:][found[1:] == found[:-1]]
    if not len(twice):
        return np.zeros(len(segments), bool)
    hit = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own
    return np.logical_or.reduceat(hit, np.cumsum(n) - n)


_SKETCH = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("g", pa.int32()), ("cells", pa.binary()), ("several", pa.binary()), ("counts", pa.binary())])


def _sketch(length: int, depth: int, width: int, block: int):
    """A row per (sketch row, block): this group's cells, which of them have several segments or one that repeats itself, and
    how many distinct ones those have."""

    def run(key, docs):
        pieces = Pieces(docs, length, inner=True)
        out: list[list] = [[] for _ in _SKETCH]
        for row in range(depth):
            cells, back, counts = np.unique(pieces.cells(row, width), return_inverse=True, return_counts=True)
            several = counts > 1
            several[back[pieces.inner]] = True
            counts = pieces.distinct(back, counts)
            blocks = (cells // np.uint64(block)).astype(np.int64)
            cuts = (np.flatnonzero(np.diff(blocks)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(cells)]):
                if b > a:
                    packed = pack_cells(cells[a:b] - np.uint64(int(blocks[a]) * block))
                    for to, x in zip(out, (row, int(blocks[a]), key[0].as_py(), packed, np.packbits(several[a:b]).tobytes(), counts[a:b][several[a:b]].tobytes())):
                        to.append(x)
        return rows(out, _SKETCH)

    return run


def _merge_names(hot_segments: int):
    """One block of one sketch row, of all groups: for each group, which of its cells are repeated, and which are hot."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack_cells(x.as_py()) for x in table.column("cells")]
        several = [bits_of(x.as_py(), len(p)) for x, p in zip(table.column("several"), parts)]
        cells, flags = np.concatenate(parts), np.concatenate(several)
        counts = np.ones(len(cells), np.int64)
        counts[flags] = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table.column("counts")])
        _, back = np.unique(cells, return_inverse=True)
        repeated = (np.bincount(back) > 1) | (np.bincount(back, flags) > 0)
        hot = np.bincount(back, counts) > hot_segments
        out: list[list] = [[], [], [], []]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        for g, row, block, a, b in zip(*(table.column(c).to_pylist() for c in ("g", "row", "block")), np.split(repeated[back], cuts), np.split(hot[back], cuts)):
            for kind, bits in ((row, a), (row + HOT, b)):
                if kind < HOT or bits.any():
                    for to, x in zip(out, (g, kind, block, np.packbits(bits).tobytes())):
                        to.append(x)
        return rows(out, REPLY)

    return run


def _candidates(pieces: Pieces, said: list[dict], depth: int, width: int, block: int, shards: int) -> None:
    flags = _repeated(pieces, said, depth, width, block)
    warm = [{**r, "row": r["row"] - HOT} for r in said if r["row"] >= HOT]
    hot = _repeated(pieces, warm, depth, width, block) if warm else np.zeros(len(flags), bool)
    pieces.candidates(flags, hot, shards)


_FOUND = pa.schema([("shard", pa.int32()), ("g", pa.int32()), *((c, pa.binary()) for c in ("sizes", "ids", "marks", "lo", "texts"))])


def _segments(length: int, depth: int, width: int, block: int, shards: int):
    """Rows for shards of segments (0 .. shards - 1), and for buckets of hot strings behind them, whose texts are digests."""

    def run(key, docs, replies):
        p = Pieces(docs, length)
        _candidates(p, replies.to_pylist(), depth, width, block, shards)
        out: list[list] = [[] for _ in _FOUND]

        def add(shard, sizes, start, texts):
            doc = np.searchsorted(p.first, start, "right") - 1
            for to, x in zip(out, (shard, key[0].as_py(), sizes, p.ids[doc].tobytes(), p.marks[doc].tobytes(), (start - p.first[doc]).tobytes(), texts)):
                to.append(x)

        for shard, a, b in p.parts():
            texts = p.texts[a:b]
            add(shard, np.array([len(t) for t in texts], np.uint32).tobytes(), p.lo[p.rep[a:b]], b"".join(texts))
        first, halves = p.strings[p.head], p.halves[p.head]
        for bucket, a, b in p.buckets():
            add(shards + bucket, b"", first[a:b], halves[a:b].tobytes())
        return rows(out, _FOUND)

    return run


def _shard(length: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        ids, marks, lo = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)]) for c, kind in (("ids", np.int64), ("marks", np.uint64), ("lo", np.int64)))
        g, shard = (table.column(c).to_pylist() for c in ("g", "shard"))
        if shard[0] >= shards:
            halves = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2) for x in table.column("texts")]
            sizes, halves = [len(x) for x in halves], np.concatenate(halves)
            group = np.repeat(g, sizes)  # equal rows of one id in several groups: the least group is first
            order = np.lexsort((group, lo, marks, ids, halves[:, 1], halves[:, 0]))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (halves[order][1:] == halves[order][:-1]).all(axis=1)
            bits = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(sizes)[:-1])]
            return rows([g, [RECORDS] * len(sizes), shard, bits], REPLY)
        per = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("sizes")]
        texts = []
        for sizes, data in zip(per, table.column("texts")):
            data, ends = data.as_py(), np.cumsum(sizes, dtype=np.int64)
            texts += [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        group = np.repeat(g, [len(x) for x in per])
        owner: dict[bytes, int] = {}
        for k in np.lexsort((group, lo, marks, ids)).tolist():
            owner.setdefault(texts[k], k)
        flags = dict(zip(owner.values(), repeats(list(owner), length)))
        bits, at = [], 0
        for sizes in per:
            own = [flags[k] if k in flags else np.ones(len(texts[k]) - length + 1, bool) for k in range(at, at + len(sizes))]
            bits.append(np.packbits(np.concatenate(own)).tobytes())
            at += len(sizes)
        return rows([g, [RECORDS] * len(per), shard, bits], REPLY)

    return run


def _remove(length: int, depth: int, width: int, block: int, shards: int, texts: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(key, docs, replies):
        p, said = Pieces(docs, length), replies.to_pylist()
        _candidates(p, said, depth, width, block, shards)
        answer = {x["block"]: x["bits"] for x in said if x["row"] == RECORDS}
        hit = [p.strings[~p.head], p.starts(p.copies)]
        for shard, a, b in p.parts():
            starts = p.starts(p.rep[a:b])
            hit.append(starts[bits_of(answer[shard], len(starts))])
        first = p.strings[p.head]
        for bucket, a, b in p.buckets():
            hit.append(first[a:b][bits_of(answer[shards + bucket], b - a)])
        gone = covered(np.concatenate(hit), length, len(p.data))
        data = np.frombuffer(p.data, np.uint8)
        out: list[list] = [[] for _ in schema]
        for k, (a, b) in enumerate(zip(p.first[:-1].tolist(), p.first[1:].tolist())):
            flags = gone[a:b]
            n = int(flags.sum())
            kept = data[a:b][~flags].tobytes() if n else p.data[a:b]
            for to, x in zip(out, (p.names[k], b - a, n, len(spans_of(flags)[0]) if n else 0, hashlib.sha256(kept).hexdigest(), kept if texts else None)):
                to.append(x)
        return rows(out, schema)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, depth: int = DEPTH, group_bytes: int = GROUP_BYTES, texts: bool = True, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of (doc_id, text): without each byte that a string of
    `length` bytes covers which also starts earlier, in a smaller doc_id or before in the same document. `kept` has the
    bytes that stay (null if not texts)."""
    base, short, groups, size = grouped(docs, length, group_bytes)
    segments = max(1, size // SEGMENT_BYTES)
    width = 1 << (CELLS_PER_SEGMENT * segments - 1).bit_length()
    block = -(-width // max(16, -(-segments // BLOCK_SEGMENTS)))
    shards = max(64, -(-size // SHARD_BYTES))
    shape = (length, depth, width, block)
    reply = "g int, row int, block int, bits binary"
    sketch = base.groupBy("g").applyInArrow(_sketch(*shape), "row int, block int, g int, cells binary, several binary, counts binary")
    cells = stage(sketch.groupBy("row", "block").applyInArrow(_merge_names(hot_segments), reply), "names")
    found = base.groupBy("g").cogroup(cells.groupBy("g")).applyInArrow(_segments(*shape, shards), "shard int, g int, sizes binary, ids binary, marks binary, lo binary, texts binary")
    answers = found.groupBy("shard").applyInArrow(_shard(length, shards), reply)
    made = base.groupBy("g").cogroup(cells.unionByName(answers).groupBy("g")).applyInArrow(
        _remove(*shape, shards, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    # texts shorter than a string stay as they are
    data, none = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit(0).cast("long")
    whole = short.select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"), (data if texts else F.lit(None).cast("binary")).alias("kept"))
    return made.unionByName(whole)
