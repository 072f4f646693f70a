"""SimHash near-duplicates by meet-in-the-middle ball hashing.

1. A narrow map computes one 64-bit fingerprint per text; equal fingerprints collapse to one row.
2. Every distinct fingerprint emits variants of itself, at most half the radius away, rounded up. The radius is 3, so two
   linked fingerprints meet when one walks 1 bit and the other 2. Which one walks 2 follows from parity: fingerprints
   with an even number of ones emit themselves, all 64 neighbours, and 992 variants at distance 2; odd ones themselves
   and their neighbours. Of the 2,016 pairs of bits those within one half of the word suffice, as of any three bits
   two lie in the same half. So every linked pair shares a variant that one of the two is at most 1 bit away from:
   distance 1: the even one itself; distance 2: the middle, at 1 bit from both; distance 3: an odd one's neighbour.
3. Variants are shuffled by hash, packed into arrays: 4 bytes each, and each fingerprint once per packet. Where a variant is
   met by several fingerprints, the nearest is linked to all others; pairs are verified by counting bits, and the star has
   one link less than members, never all pairs. A ball bounds the members of a variant, whatever the corpus.
4. Links are deduplicated and their connected components taken in distributed rounds.

`near_duplicates` takes those links as they are: three words, 3 bits. `keep_one`, for a corpus to be filtered, takes five words and
a similarity of shingle sets of 0.8: the links are only candidates there, held against the sets themselves. Two sets
that are 0.8 alike differ in 10 bits on average, which no ball of half that radius can span (10^7 variants), so candidates from
`minhash`, which reach that far, come on top. Neither is complete: balls and hot bands give stars, not all pairs. So their components are
completed by the prefixes of `minhash`, which lose no pair of sets 0.8 alike in different components.

Nulls, empty texts and texts without words get fingerprint zero and link like any other. A null doc_id is no candidate for a
component's name; a component with no other gets null. Repeated rows return one row each, an empty table none. Very long texts
are read whole, shingles hashed in one pass. Other columns than doc_id and text are not read; keep_one returns them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .shared import components, kept_rows, mix, scope, slices, small_batches, stage

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Variants that one bucket gets on average; fingerprints in one packet.
BUCKET_VARIANTS = 2_000_000
PACKET = 4096
LEAST_BUCKETS = 64
#: Variants that one task emits, and that one task holds when it repacks; codes that a packet's row has at least on average.
TASK_VARIANTS = 8_000_000
ROW_CODES = 128
#: Variants that are made and hashed at once.
BLOCK = 100_000


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash over the XXH64 of k-word shingles, repeats included; words are lowered in A-Z only."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    n = len(words) - k + 1
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 65536):
        ones += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp) with fp as a signed long; a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            fps = np.array([fingerprint(t, k, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _masks() -> np.ndarray:
    """What a variant flips: nothing, one bit, and for even fingerprints two bits of one half."""
    one = [1 << i for i in range(64)]
    two = [1 << i | 1 << j for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
    return np.array([0, *one, *two], np.uint64)


MASKS = _masks()
NEAR = 65  # masks of at most one bit

_PACKETS = pa.schema([("bucket", pa.int32()), ("owners", pa.binary()), ("codes", pa.binary())])


def _variants(fps: np.ndarray, who: np.ndarray, what: np.ndarray, buckets: int | None = None) -> np.ndarray:
    """fps[who] ^ MASKS[what], or their buckets, made in blocks: many millions come at once, and each step of the hash would hold them all."""
    out = np.empty(len(who), np.uint64 if buckets is None else np.uint16 if buckets <= 65536 else np.uint32)
    for a in range(0, len(who), BLOCK):
        made = fps[who[a : a + BLOCK]] ^ MASKS[what[a : a + BLOCK]]
        out[a : a + BLOCK] = made if buckets is None else mix(made) % np.uint64(buckets)
    return out


def _packed(fps: np.ndarray, who: np.ndarray, what: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A row per bucket: the fingerprints that have a variant there, once each, and the variants' codes (owner, mask)."""
    order = np.argsort(bucket, kind="stable")
    who, what, bucket = who[order], what[order], bucket[order]
    del order
    found, owners, packed = [], [], []
    cuts = (np.flatnonzero(np.diff(bucket)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(bucket)]):
        if b > a:
            used, index = np.unique(who[a:b], return_inverse=True)
            found.append(int(bucket[a]))
            owners.append(fps[used].tobytes())
            packed.append((index.astype(np.uint32) << np.uint32(11) | what[a:b].astype(np.uint32)).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(owners, pa.binary()), pa.array(packed, pa.binary())], schema=_PACKETS)


def _emit(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(all_fps), PACKET):
                fps = all_fps[at : at + PACKET]
                odd = (np.bitwise_count(fps) & 1).astype(bool)
                who, what = [], []
                for part, n in ((np.flatnonzero(~odd), len(MASKS)), (np.flatnonzero(odd), NEAR)):
                    who.append(np.repeat(part.astype(np.uint16), n))
                    what.append(np.tile(np.arange(n, dtype=np.uint16), len(part)))
                who, what = np.concatenate(who), np.concatenate(what)
                yield _packed(fps, who, what, _variants(fps, who, what, buckets))

    return run


def links_of(fps: np.ndarray, owner: np.ndarray, code: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Verified links, n x 2, among the owners (indexes into fps) that meet on a variant."""
    variant = _variants(fps, owner, code)
    met = np.sort(variant)
    met = np.unique(met[1:][met[1:] == met[:-1]])  # variants of several owners
    if not len(met):
        return np.empty((0, 2), np.uint64)
    found = []
    for a in range(0, len(variant), BLOCK):
        made = variant[a : a + BLOCK]
        found.append(a + np.flatnonzero(met[np.minimum(np.searchsorted(met, made), len(met) - 1)] == made))
    order = np.concatenate(found)
    variant = variant[order]
    fp, far = fps[owner[order]], np.bitwise_count(MASKS[code[order]])
    order = np.lexsort((fp, far, variant))
    variant, fp, far = variant[order], fp[order], far[order]
    head = np.concatenate(([True], variant[1:] != variant[:-1]))
    centre = np.flatnonzero(head)[np.cumsum(head) - 1]
    keep = (far[centre] <= 1) & (fp != fp[centre]) & (np.bitwise_count(fp ^ fp[centre]) <= radius)
    return np.unique(np.stack([fp[centre][keep], fp[keep]], axis=1), axis=0)


def _meet(packets: pa.Table) -> pa.Table:
    fps, owner, code, at = [], [], [], 0
    for o, c in zip(packets.column("owners"), packets.column("codes")):
        f, x = np.frombuffer(o.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint32)
        fps.append(f)
        owner.append((x >> 11) + np.uint32(at))
        code.append((x & 2047).astype(np.uint16))
        at += len(f)
    found = links_of(np.concatenate(fps), np.concatenate(owner), np.concatenate(code))
    return pa.table({"a": pa.array(found[:, 0].view(np.int64)), "b": pa.array(found[:, 1].view(np.int64))})


def _repacked(split: int):
    """Packets of coarse buckets, `split` buckets each, parted by bucket; a task holds TASK_VARIANTS codes at a time."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        fps, who, what, at = [], [], [], 0
        for f, x in held:
            fps.append(f)
            who.append((x >> 11) + np.uint32(at))
            what.append((x & 2047).astype(np.uint16))
            at += len(f)
        held.clear()
        fps, who, what = np.concatenate(fps), np.concatenate(who), np.concatenate(what)
        return _packed(fps, who, what, _variants(fps, who, what, split))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for o, c in zip(batch.column("owners"), batch.column("codes")):
                held.append((np.frombuffer(o.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint32)))
                n += len(held[-1][1])
                if n >= TASK_VARIANTS:
                    yield flush(held)
                    n = 0
        if held:
            yield flush(held)

    return run


def links(fps: DataFrame, bucket_variants: int = BUCKET_VARIANTS, row_codes: int = ROW_CODES) -> DataFrame:
    """(a, b): links that join every two values of `fp` (distinct, a written table) within RADIUS bits.

    Where there are so many buckets that a packet's rows would hold few codes each, packets go to coarse buckets first,
    and are parted there, many together.
    """
    variants = fps.count() * (len(MASKS) + NEAR) // 2
    buckets = max(LEAST_BUCKETS, -(-variants // bucket_variants))
    coarse = min(buckets, max(LEAST_BUCKETS, PACKET * (len(MASKS) + NEAR) // 2 // row_codes))
    form = "bucket int, owners binary, codes binary"
    packets = fps.repartition(max(1, -(-variants // TASK_VARIANTS)), "fp").mapInArrow(_emit(coarse), form)
    if buckets > coarse:
        split = coarse * -(-buckets // coarse)  # a multiple, so that a bucket lies in one coarse bucket
        packets = packets.repartition(coarse, "bucket").mapInArrow(_repacked(split), form)
    return packets.groupBy("bucket").applyInArrow(_meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) per row of (doc_id, text); component_id is the least doc_id reachable over links."""
    with scope() as keep:
        marked = keep(stage(fingerprints(docs, k, seed), "fingerprints"))
        firsts = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
        roots = components(links(firsts.select("fp")), "simhash")
        rooted = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
        named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
        named = keep(stage(named, "named"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates, all columns kept: of each component of texts whose sets of five-word shingles are at least
    0.8 alike, the row with the least doc_id stays.

    Null doc_ids come last, and rows that share an id follow the hash of their texts; of rows that agree in id and text
    one stays, whichever. Nulls and texts without words have the empty set in common.
    """
    with scope() as keep, small_batches(docs.sparkSession):
        marked = stage(minhash.signatures(docs, minhash.frequent(docs)), "signatures")
        order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
        distinct = stage(marked.groupBy("fp").agg(F.min(order).alias("best"), *[F.first(c).alias(c) for c in ("n", "sim", "bands", "prefix")]), "distinct")
        # sets of one fingerprint, and fingerprints within a ball, as pairs of sets
        sims = stage(distinct.where("n > 0").groupBy("sim").agg(F.min("fp").alias("one")), "sims")
        near = links(sims.select(F.col("sim").alias("fp")))
        name = lambda side: sims.select(F.col("sim").alias(side), F.col("one").alias(f"{side}_set"))
        balls = near.join(name("a"), "a").join(name("b"), "b").select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))
        same = distinct.where("n > 0").join(sims, "sim").where("fp <> one").select(F.col("one").alias("a"), F.col("fp").alias("b"))
        pairs = stage(balls.union(same).union(minhash.candidates(distinct)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        roots = components(minhash.verified(docs, distinct, pairs), "similar")
        named = distinct.select("fp", "best").join(roots, distinct.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), "best")
        rest = stage(minhash.across(distinct, roots), "rest")
        if not rest.isEmpty():
            name = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
            links_left = minhash.verified(docs, distinct, rest).join(name("a"), "a", "left").join(name("b"), "b", "left")
            joined = components(links_left.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")), "joined")
            named = named.join(joined, named.root == joined.node, "left").select(F.coalesce(joined.root, named.root).alias("root"), "best")
        best = keep(stage(named.groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.text_hash"), "kept"))
        # rows that agree in id and text, if the table has any at all
        again = marked.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
        again = keep(stage(again.join(best, (again.doc_id.eqNullSafe(best.doc_id)) & (again.text_hash == best.text_hash), "left_semi").select("doc_id", "text_hash"), "repeated"))
    return kept_rows(docs, best, again)
