"""The similarity of word shingles, for simhash.keep_one: MinHash bands name candidates, shingle sets decide.

1. A narrow map makes the set of a text's five-word shingles (hashes), the set's own hash, its SimHash, and 30 band keys of five
   minima each; texts of equal sets collapse to one row. Two sets of Jaccard similarity 0.8 share no band once in 150,000 pairs.
2. Band keys are shuffled by hash, packed into arrays. Up to SMALL sets that share a key are paired with one another; of more, the
   most typical ones (hubs) are paired with all, so pairs stay linear in the members. Sizes that rule 0.8 out are dropped.
3. Only sets that are in a pair are made again from their texts and joined to the pairs; a link is a pair whose exact similarity
   is at least 0.8. Connected components of the links follow in distributed rounds.
4. What bands and their hubs leave out is found by prefixes, which lose no pair: of two sets 0.8 alike, the first shingle in common, in an
   order of all shingles, is among the first fifth of each, rounded down, and one more. Pairs within one component need no further link,
   so shingles met in one component only drop out. The rest is paired across components where the shingle can be the first in common by its
   place in either set, held against the number in common in the prefixes, and verified like the others. Any order is right; to keep
   pairs few, shingles that recur within chunks of the corpus come last.

Texts without words, and nulls, have the empty set in common. Texts of fewer than five words are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix, rolling, slices, stage

SHINGLE = 5
#: The least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
BANDS, MINIMA = 30, 5
#: Bands of which a byte goes along with each set, to tell how typical it is of those that share a key.
TAGS = 16
SMALL, HUBS, AGREE = 32, 4, 4
BUCKET_KEYS = 2_000_000
#: Band keys that one task emits.
TASK_KEYS = 500_000
PACKET = 4096
LEAST_BUCKETS = 64
#: Shingles of a chunk in which repeats are counted, repeats in all that make a shingle a frequent one, and most frequent ones that tasks hold.
CHUNK, REPEATS, FREQUENT = 2_000_000, 16, 1_000_000
#: Sets that share a shingle of their prefixes and are held against one another without looking at the sizes that fit first.
HOT = 64
#: Most sets to be verified that are joined to the texts by a broadcast.
FEW_SETS = 200_000

_SALTS = mix(np.arange(1, 2 * BANDS * MINIMA + 1, dtype=np.uint64))
_TIMES, _PLUS = _SALTS[: BANDS * MINIMA] | np.uint64(1), _SALTS[BANDS * MINIMA :]
_JOIN = mix(np.arange(1, MINIMA + 1, dtype=np.uint64), 5) | np.uint64(1)
_OWNER = np.dtype([("set", "<i8"), ("n", "<i4"), ("tags", "u1", TAGS)])
_KEY = np.dtype([("owner", "<u2"), ("key", "<u8")])


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the k-word shingles, sorted; words are lowered in A-Z only."""
    import xxhash

    words = (text or "").encode().lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(mix(rolling(h, min(k, len(h))))) if words else h


def sim_of(found: np.ndarray) -> int:
    """64 bits: 1 where over half of the hashes have 1."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(found), 65536):
        ones += np.unpackbits(found[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view(np.uint64)[0])


def band_keys(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 2048):
        np.minimum(least, (found[a : a + 2048, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return mix((least.reshape(BANDS, MINIMA) * _JOIN).sum(axis=1, dtype=np.uint64) + _PLUS[:BANDS])


def repeated(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What comes twice or more in the arrays together, sorted, and how often. Sorted in place, and the list is emptied, as a chunk is large."""
    line = np.concatenate(held)
    held.clear()
    line.sort()
    again = np.zeros(len(line) + 1, bool)  # equal to the one before
    np.equal(line[1:], line[:-1], out=again[1:-1])
    first, last = np.flatnonzero(~again[:-1] & again[1:]), np.flatnonzero(again[:-1] & ~again[1:])
    return line[first], last - first + 1


def frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that recur, the more frequent the later; they only order the shingles of a prefix, so what is missing here costs time, not pairs."""

    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = repeated(held)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch.column("text")):
                for text in part.to_pylist():
                    held.append(shingles(text))
                    size += len(held[-1])
                    if size >= CHUNK:
                        yield count(held)
                        size = 0
        if held:
            yield count(held)

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= REPEATS).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    return top.column("key").to_numpy().view(np.uint64)[::-1].copy()


def prefix(found: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The shingles of which a set 0.8 alike has one as the first in common. last: frequent shingles, sorted, and their places in the order."""
    up, down = SIMILARITY
    size = len(found) - -(-len(found) * up // down) + 1
    if not len(found) or not len(last):
        return found[:size]
    at = np.minimum(np.searchsorted(last, found), len(last) - 1)
    late = last[at] == found
    rare = found[~late]
    return rare[:size] if len(rare) >= size else np.concatenate([rare, found[late][np.argsort(place[at[late]])]])[:size]


def signatures(docs: DataFrame, late: np.ndarray | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, n, sim, bands, prefix): fp names the set of shingles, n is its size, sim its SimHash; a narrow map. late: frequent()."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("sim", pa.int64()), ("bands", pa.binary()), ("prefix", pa.list_(pa.int64()))])
    late = np.empty(0, np.uint64) if late is None else late
    place = np.argsort(late)
    order = docs.sparkSession.sparkContext.broadcast((late[place], place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (part for whole in batches for part in slices(whole)):
            fps, sizes, sims, bands, firsts = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                fps.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                sims.append(sim_of(found))
                bands.append(band_keys(found).tobytes())
                firsts.append(prefix(found, *order.value).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(sims, np.uint64).view(np.int64)), pa.array(bands, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))], schema=schema)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long, n int, sim long, bands binary, prefix array<long>")


def _emit(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), PACKET):
                batch = whole.slice(at, PACKET)
                keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.uint64).reshape(-1, BANDS)
                owners = np.empty(len(batch), _OWNER)
                owners["set"], owners["n"] = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "n"))
                owners["tags"] = keys[:, :TAGS] & np.uint64(255)
                bucket = (mix(keys.ravel(), 9) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                out: list[list] = [[], [], []]
                for part in np.split(order, cuts):
                    used, index = np.unique(part // BANDS, return_inverse=True)
                    packed = np.empty(len(part), _KEY)
                    packed["owner"], packed["key"] = index, keys.ravel()[part]
                    for to, x in zip(out, (int(bucket[part[0]]), owners[used].tobytes(), packed.tobytes())):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "owners", "keys"])

    return run


def _paired(tags: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs, as index arrays, among sets that share a key."""
    out, left = [], np.arange(len(tags))
    for _ in range(HUBS):
        if len(left) <= SMALL:
            break
        some = tags[left]
        hub = left[np.argmax(sum(np.bincount(c, minlength=256)[c] for c in some.T))]
        out.append((np.full(len(tags), hub), np.arange(len(tags))))
        left = left[(some == tags[hub]).sum(axis=1) < AGREE]
    if len(left) <= SMALL:
        a, b = np.triu_indices(len(left), 1)
        out.append((left[a], left[b]))
    else:
        out.append((left[:-1], left[1:]))
    return out


def _meet(packets: pa.Table) -> pa.Table:
    owners, keys, who, at = [], [], [], 0
    for o, k in zip(packets.column("owners"), packets.column("keys")):
        o, k = np.frombuffer(o.as_py(), _OWNER), np.frombuffer(k.as_py(), _KEY)
        owners.append(o)
        keys.append(k["key"])
        who.append(k["owner"].astype(np.int64) + at)
        at += len(o)
    owners, keys, who = np.concatenate(owners), np.concatenate(keys), np.concatenate(who)
    order = np.lexsort((owners["set"][who], keys))
    keys, who = keys[order], who[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(starts[1:], len(keys))
    two = starts[ends - starts == 2]
    pairs = [(who[two], who[two + 1])]
    for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
        part = who[a:b]
        pairs += [(part[x], part[y]) for x, y in _paired(owners["tags"][part])]
    x, y = (owners[np.concatenate(p)] for p in zip(*pairs))
    up, down = SIMILARITY
    close = (x["set"] != y["set"]) & (down * np.minimum(x["n"], y["n"]).astype(np.int64) >= up * np.maximum(x["n"], y["n"]).astype(np.int64))
    x, y = x["set"][close], y["set"][close]
    found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    return pa.table({"a": pa.array(found[:, 0].copy(), pa.int64()), "b": pa.array(found[:, 1].copy(), pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        found = [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(found, pa.list_(pa.int64()))], ["fp", "found"])


def candidates(distinct: DataFrame) -> DataFrame:
    """(a, b): names of sets that share a band. distinct: (fp, n, bands), a written table."""
    keys = distinct.count() * BANDS
    buckets = max(LEAST_BUCKETS, -(-keys // BUCKET_KEYS))
    spread = distinct.where("n > 0").select("fp", "n", "bands").repartition(max(1, -(-keys // TASK_KEYS)), "fp")
    packets = spread.mapInArrow(_emit(buckets), "bucket int, owners binary, keys binary")
    return packets.groupBy("bucket").applyInArrow(_meet, "a long, b long")


def meetings(met: DataFrame) -> DataFrame:
    """(a, b): pairs of sets of different components that meet on a key which can be their first shingle in common; a row for each such key.
    met: (key, fp, n, left, root), left being how many of the set's n shingles come at the key or later; a written table.

    From the first shingle in common on, each of two sets must hold what they have to share. So a key deep in a set's order joins it
    to sets of a few sizes only, to which it comes early. Keys of up to HOT sets are joined as they are; for the others, the (n, left) that fit
    are found first, of which there are few whatever the number of sets, and only sets that fit are joined.
    """
    up, down = SIMILARITY
    # each pair has a set outside the key's largest component; that one's own pairs, which may be very many, are not formed
    per = met.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("total"))
    per = stage(per, "per_key")
    other = lambda df: df.where("root <> main").select("key", "main", *[F.col(c).alias(f"x_{c}") for c in ("fp", "n", "left", "root")])
    apart = (F.col("x_root") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("x_fp") < F.col("fp")))
    fits = F.least("left", "x_left") * (up + down) >= (F.col("n") + F.col("x_n")) * up
    few = other(met.join(per.where(F.col("total") <= HOT), "key")).join(met, "key").where(apart & fits)
    hot = stage(met.join(per.where(F.col("total") > HOT), "key"), "hot")
    outer, inner = other(hot), hot.drop("main", "total")
    forms = outer.select("key", "x_n", "x_left").distinct().join(inner.select("key", "n", "left").distinct(), "key").where(fits)
    many = outer.join(forms, ["key", "x_n", "x_left"]).join(inner, ["key", "n", "left"]).where(apart)
    return few.select("x_fp", "fp").union(many.select("x_fp", "fp")).select(F.least("x_fp", "fp").alias("a"), F.greatest("x_fp", "fp").alias("b"))


def across(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): all pairs of sets of different components that can be SIMILARITY alike. distinct: (fp, n, prefix); roots: (node, root)."""
    up, down = SIMILARITY
    rooted = stage(distinct.where("n > 0").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), "prefix"), "rooted")
    keys = rooted.select("fp", "n", "root", F.posexplode("prefix").alias("at", "key")).select("key", "fp", "n", (F.col("n") - F.col("at")).alias("left"), "root")
    mixed = stage(keys.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key"), "mixed")
    pairs = stage(meetings(stage(keys.join(mixed, "key"), "met")).distinct(), "meeting")
    needed = stage(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), "meeting_sets")
    firsts = stage(rooted.join(needed, "fp", "left_semi").select("fp", "n", "prefix"), "prefixes")
    side = lambda c, n, x: firsts.select(F.col("fp").alias(c), F.col("n").alias(n), F.col("prefix").alias(x))
    both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    # what two sets have in common besides the shingles in both prefixes lies behind the prefix that ends first
    behind = F.floor((F.greatest("n", "m") * up + down - 1) / down) - 1
    return both.where((F.size(F.array_intersect("x", "y")) + behind) * (up + down) >= (F.col("n") + F.col("m")) * up).select("a", "b")


def verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b), a written table, whose sets are at least SIMILARITY alike. distinct: (fp, best) with best a row of docs."""
    needed = stage(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(distinct.select("fp", "best"), "fp"), "needed")
    if needed.count() <= FEW_SETS:
        needed = F.broadcast(needed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = rows.alias("d").join(needed.alias("k"), F.expr("d.doc_id <=> k.best.doc_id and d.text_hash = k.best.text_hash")).select("k.fp", "d.text")
    sets = stage(texts.mapInArrow(_sets, "fp long, found array<long>").dropDuplicates(["fp"]), "sets")
    left, right = sets.select(F.col("fp").alias("a"), F.col("found").alias("x")), sets.select(F.col("fp").alias("b"), F.col("found").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
    up, down = SIMILARITY
    return both.where(F.col("common") * down >= (F.col("n") - F.col("common")) * up).select("a", "b")
