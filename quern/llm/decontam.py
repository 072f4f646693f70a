"""Benchmark decontamination: which words of the corpus lie inside a passage of a test set.

The test items' word n-grams become a hash set that every executor holds; one narrow scan of the corpus looks up each
window, verifies hits word by word, and removes spans or documents. The set is only broadcast while its items are below a
byte bound; a larger test set is cut into blocks of about that size, each scanned the same way, and the blocks' hits are merged.

Nulls and texts without words have no windows: nothing in them is hit, and such items never occur. A null item_id cannot be
named: its item marks hits and counts, but is left out of the list of ids; equal items count once. Null or repeated doc_ids pass
through as rows, an empty table gives no rows, and a very long text is one row's arrays. decontaminate keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import covered, fresh, mix, rolling, spans_of, stage

#: Consecutive words of a window.
WINDOW = 10
#: Bytes of test items' texts in one broadcast block. What is built of them takes up to about ten times as much: 20 bytes a window
#: and a dictionary of the distinct words.
BLOCK_BYTES = 8_000_000

#: Windows compared at once when the set is built.
CHUNK = 100_000

# Word characters are digits, letters and everything from U+0080 on; A-Z are lowered.
_CLASSES = bytes(b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_CLASSES).split()


class Ngrams:
    """Windows of the test items, in arrays: `line` has all items' words as numbers; for each length of window, hashes in order,
    where in `line` the window of each begins, and where in `owners` the items that have it begin."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.names = [i for i, _ in items]
        parts = [np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)], np.uint64) for _, text in items]
        sizes = np.array([len(p) for p in parts], np.int64)
        first = np.cumsum(sizes) - sizes
        self.line = np.concatenate([*parts, np.zeros(0, np.uint64)])
        hashed = mix(self.line)
        self.by_length = {}
        for n in sorted({min(int(k), window) for k in sizes if k}):
            who = np.flatnonzero(sizes >= n if n == window else sizes == n)
            count = sizes[who] - n + 1
            at = np.arange(int(count.sum())) + np.repeat(first[who] - (np.cumsum(count) - count), count)
            owner = np.repeat(who, count)
            h = mix(rolling(hashed, n)[at])
            order = np.lexsort((owner, h))
            h, at, owner = h[order], at[order], owner[order]
            head = np.ones(len(h), bool)
            head[1:] = h[1:] != h[:-1]
            lead = at[head][np.cumsum(head) - 1]
            for a in range(0, len(at), CHUNK):
                b = a + CHUNK
                for k in a + np.flatnonzero((self._words(at[a:b], n) != self._words(lead[a:b], n)).any(axis=1)):  # hashes collide: a group each
                    head[k : k + 2] = True
            twin = np.zeros(len(h), bool)
            twin[1:] = ~head[1:] & (owner[1:] == owner[:-1])  # an item that has a window twice
            keep = head | ~twin
            group = np.flatnonzero(head[keep])
            self.by_length[n] = h[head], at[head], np.append(group, int(keep.sum())), owner[keep].astype(np.int32)

    def _words(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.line[at[:, None] + np.arange(n)]

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Flags of a document's words that an occurring window covers, and the items that have one. 0: a word of no item."""
        flags, items = np.zeros(len(numbers), bool), set()
        known = numbers > 0
        if not known.any():
            return flags, items
        hashed = mix(numbers)
        upto = np.concatenate(([0], np.cumsum(known)))
        for n, (hashes, at, first, owners) in self.by_length.items():
            starts = np.flatnonzero(upto[n:] - upto[:-n] == n) if len(numbers) >= n else upto[:0]
            if not len(starts):
                continue
            h = mix(rolling(hashed, n)[starts])
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            found = []
            while (some := low < high).any():  # more than one round only where hashes collide
                starts, low, high = starts[some], low[some], high[some]
                same = (self._words(at[low], n) == numbers[starts[:, None] + np.arange(n)]).all(axis=1)
                found.append(starts[same])
                for k in np.unique(low[same]).tolist():
                    items.update(owners[first[k] : first[k + 1]].tolist())
                low = low + 1
            if found:
                flags |= covered(np.concatenate(found), n, len(numbers))
        return flags, items


class _Numbers(dict):
    def __missing__(self, word):
        return 0


FOUND = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("item_ids", pa.list_(pa.string())), ("n_unnamed", pa.int64())])
SCAN = "doc_id long, text string, n_words long, spans array<struct<s:long,e:long>>, item_ids array<string>, n_unnamed long"


def _blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Ngrams, bool]]:
    """The test items' windows, in blocks whose size is known to be below the bound before they are collected; True with the last."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        yield Ngrams([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()], window), k == blocks - 1


def _scan(docs: DataFrame, grams: Ngrams, first: bool, last: bool) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value
        get = _Numbers(g.ids).__getitem__
        for batch in batches:
            rows = batch.to_pydict()
            n_words, spans, names, unnamed = [], [], [], []
            for k, text in enumerate(rows["text"]):
                w = words_of(text)
                flags, hit = g.hits(np.fromiter(map(get, w), np.uint64, len(w)))
                n_words.append(len(w))
                spans.append(([] if first else rows["spans"][k]) + [{"s": a, "e": b} for a, b in zip(*(x.tolist() for x in spans_of(flags)))])
                ids = [g.names[i] for i in hit]
                names.append(sorted({*(() if first else rows["item_ids"][k]), *(i for i in ids if i is not None)}))
                unnamed.append((0 if first else rows["n_unnamed"][k]) + sum(i is None for i in ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.nulls(len(n_words), pa.string()) if last else batch.column("text"), *(pa.array(x, f.type) for x, f in zip((n_words, spans, names, unnamed), list(FOUND)[2:]))], schema=FOUND)

    return docs.mapInArrow(run, SCAN)


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, item_ids, n_unnamed): word spans of docs (doc_id, text) inside windows of items (item_id, text).

    A narrow map. Each further block scans the table that the block before it left in the shared folder.
    """
    now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for k, (grams, last) in enumerate(_blocks(items, window, block_bytes)):
        now = _scan(stage(now, "decontam") if k else now, grams, k == 0, last)
    return now.drop("text")


def digest(hits: DataFrame) -> DataFrame:
    """Per document the counts of words, hit words and items, and the hash of the items' ids."""
    # spans of several blocks may overlap: what a span adds is its part beyond the furthest end so far
    covered_words = F.expr(
        "aggregate(array_sort(spans), named_struct('end', 0L, 'n', 0L), "
        "(acc, x) -> named_struct('end', greatest(acc.end, x.e), 'n', acc.n + greatest(0L, x.e - greatest(acc.end, x.s))), acc -> acc.n)"
    )
    return hits.select(
        "doc_id",
        "n_words",
        covered_words.alias("n_hit"),
        (F.size("item_ids") + F.col("n_unnamed")).cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without what is contaminated, all columns kept.

    remove="documents" drops every document with a hit word. remove="spans" cuts the text from each hit span's first
    character to its last and keeps the rest as it is; where the table has n_chars, it follows.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    names, (mark,) = docs.columns, fresh(docs, "cuts")
    now = docs.withColumn(mark, F.expr("cast(array() as array<struct<s:long,e:long>>)"))
    for k, (grams, _) in enumerate(_blocks(items, window, block_bytes)):
        now = _mark(stage(now, "decontam") if k else now, grams, mark)
    if remove == "documents":
        return now.where(F.size(mark) == 0).select(*names)
    # the spans of several blocks may overlap: a cut begins where the text kept so far ends, at the least
    raw = "encode(text, 'utf-8')"
    kept = F.expr(
        f"decode(aggregate(array_sort({mark}), named_struct('at', 1L, 'out', cast('' as binary)), "
        f"(acc, x) -> named_struct('at', greatest(acc.at, x.e + 1L), 'out', concat(acc.out, substring({raw}, cast(acc.at as int), cast(greatest(0L, x.s + 1 - acc.at) as int)))), "
        f"acc -> concat(acc.out, substring({raw}, cast(acc.at as int), length({raw})))), 'utf-8')"
    )
    out = now.withColumn("text", F.when(F.size(mark) > 0, kept).otherwise(F.col("text"))).select(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def _mark(docs: DataFrame, grams: Ngrams, out: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(grams)

    @F.pandas_udf("array<struct<s:long,e:long>>")
    def cuts(texts):
        import pandas as pd

        g = held.value
        get = _Numbers(g.ids).__getitem__

        def one(text):
            w = words_of(text)
            flags, hit = g.hits(np.fromiter(map(get, w), np.uint64, len(w)))
            if not hit:
                return []
            plain, at, places = text.encode().translate(_CLASSES), 0, []
            for x in w:
                at = plain.index(x, at)
                places.append((at, at + len(x)))
                at += len(x)
            return [{"s": places[a][0], "e": places[b - 1][1]} for a, b in zip(*(x.tolist() for x in spans_of(flags)))]

        return pd.Series([one(t) for t in texts], dtype=object)

    return docs.withColumn(out, F.concat(out, cuts(F.col("text").cast("string"))))
