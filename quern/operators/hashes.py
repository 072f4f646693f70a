"""Links between near 64-bit hashes, without loss and without groups that grow with a hot band.

Equal hashes are one row with a count first. The 64 bits are cut into bands so that any two hashes within the radius are near in one of
them: a band is near if it differs in no bit, or, where each hash is listed under its band and under the band with each one bit turned,
in two bits at the most. How many bands of either kind there are follows from the number of hashes: few wide bands list more rows, many
narrow ones compare more pairs.

A band value that more than LIMIT hashes are listed under is not compared: its rows are listed again under bands of the other bits,
which hashes within the radius must be near in too, and so on to a third level. Each pair is found under the lowest band that is near
and under one of the values that both are listed under, so it is reported once without a distinct.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written

#: Rows listed under one band value beyond which they are listed again by other bits, and how often that is done.
LIMIT, LEVELS = 2_000, 3


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sql(x: int) -> str:
    """An unsigned number as a signed literal; the least one cannot be written as such."""
    x = _signed(x)
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


@functools.lru_cache(maxsize=4096)
def bands(used: int, n: int, radius: int) -> tuple[tuple[int, bool], ...]:
    """(mask, turned) for each band of the bits that `used` leaves, by least cost for n hashes; none where the bits are too few. A pair within
    the radius has a band with no differing bit, or one of the turned ones with two at the most: 3 a turned band and 1 a plain one exceed it."""
    rest = [k for k in range(64) if not used >> k & 1]
    best = None
    for turned in range(radius // 3 + 2):
        plain = max(0, radius + 1 - 3 * turned)
        m = turned + plain
        if len(rest) < 2 * m:
            continue
        width = len(rest) / m
        listed = turned * (1 + width) + plain
        compared = (turned * (1 + width) ** 2 + plain) * n / 2**width / 2
        if best is None or listed + compared < best[0]:
            best = (listed + compared, turned, m)
    if best is None:
        return ()
    _, turned, m = best
    edges = [round(k * len(rest) / m) for k in range(m + 1)]
    return tuple((sum(1 << b for b in rest[a:z]), k < turned) for k, (a, z) in enumerate(zip(edges, edges[1:])))


def _listed(rows: DataFrame, cuts: dict[int, tuple[tuple[int, bool], ...]]) -> DataFrame:
    """rows (h, used, masks, flips, key) once for each band of their `used`, and for each turned bit of it."""
    flips = lambda mask, turned: ", ".join(map(_sql, [0, *(1 << b for b in range(64) if turned and mask >> b & 1)]))
    entries = lambda cut: ", ".join(f"named_struct('mask', {_sql(mask)}, 'turns', array({flips(mask, turned)}))" for mask, turned in cut)
    arrays = [f"when {_sql(used)} then array({entries(cut)})" for used, cut in cuts.items()]
    return (
        rows.selectExpr("*", f"inline(case used {' '.join(arrays)} end) as (mask, turns)")
        .selectExpr("h", "used", "masks", "flips", "key", "mask", "explode(turns) as flip")
        .selectExpr("h", "used | mask as used", "array_append(masks, mask) as masks", "array_append(flips, flip) as flips", "xxhash64(key, mask, (h & mask) ^ flip) as key")
    )


def _met(rows: DataFrame, cuts: dict[int, tuple[tuple[int, bool], ...]], radius: int) -> DataFrame:
    """(left, right) of hashes listed under one key that are within the radius, by the rule that finds a pair once."""
    # bands before each one, with how many differing bits make them near
    table = []
    for used, cut in cuts.items():
        for k, (mask, turned) in enumerate(cut):
            earlier = ", ".join(f"named_struct('m', {_sql(m)}, 't', {2 if t else 0})" for m, t in cut[:k]) or "named_struct('m', -1L, 't', -1)"
            table.append(f"when c.used = {_sql(used)} and c.mask = {_sql(mask)} then array({earlier})")
    alone = f"""forall(sequence(0, size(a.masks) - 1), i -> exists(array(struct(a.masks[i] as mask, aggregate(slice(a.masks, 1, i), 0L, (x, m) -> x | m) as used, (a.h ^ b.h) & a.masks[i] as d, a.flips[i] as fa, b.flips[i] as fb)), c ->
      case bit_count(c.d) when 0 then c.fa = 0 and c.fb = 0 when 1 then c.fa = 0 and c.fb = c.d when 2 then c.fa = (c.d & -c.d) and c.fb = (c.d ^ c.fa) else false end
      and forall(case {' '.join(table)} end, e -> bit_count((a.h ^ b.h) & e.m) > e.t)))"""
    pairs = rows.alias("a").join(rows.alias("b"), F.expr(f"a.key = b.key and a.h < b.h and bit_count(a.h ^ b.h) <= {radius}"))
    return pairs.where("a.masks = b.masks").where(F.expr(alone)).selectExpr("a.h as left", "b.h as right")


def levels(hashes: DataFrame, n: int, radius: int, limit: int = LIMIT):
    """(rows, cuts) level by level: rows under keys of at most `limit` rows, or of the last level, and all cuts so far."""
    rows = hashes.selectExpr("h", "0L as used", "cast(array() as array<bigint>) as masks", "cast(array() as array<bigint>) as flips", "0L as key")
    cuts: dict[int, tuple] = {}
    front = {0}
    for level in range(LEVELS):
        new = {u: cut for u in front if (cut := bands(u, n if level == 0 else limit, radius))}
        if not new:
            return
        cuts |= new
        rows = written(_listed(rows.where(F.col("used").isin([_signed(u) for u in new])), new), "hash_bands")
        front = {u | mask for u, cut in new.items() for mask, _ in cut}
        deeper = level + 1 < LEVELS and all(bands(u, limit, radius) for u in front)
        hot = rows.groupBy("key").count().where(F.col("count") > limit).select("key") if deeper else None
        hot = written(hot, "hash_hot") if deeper else None
        if hot is None or hot.isEmpty():
            yield rows, dict(cuts)
            return
        yield rows.join(hot, "key", "left_anti"), dict(cuts)
        rows = rows.join(hot, "key", "left_semi")


def near_links(df: DataFrame, hash_: str = "ahash", radius: int = 8, limit: int = LIMIT) -> DataFrame:
    """(left, right, distance, left_n, right_n): every pair of different hashes at most `radius` bits apart, the lesser one left, and how
    many rows have each; rows of one hash are near without a link, and null hashes are near nothing."""
    if not 0 <= radius <= 20:
        raise ValueError("a radius of 0 to 20 bits")
    hashes = written(df.where(F.col(hash_).isNotNull()).groupBy(F.col(hash_).alias("h")).agg(F.count("*").alias("n")), "hash_values")
    found = hashes.selectExpr("h as left", "h as right").where("false")
    for rows, cuts in levels(hashes.select("h"), hashes.count(), radius, limit):
        found = found.unionByName(_met(rows, cuts, radius))
    count = lambda side: hashes.select(F.col("h").alias(side), F.col("n").alias(f"{side}_n"))
    return found.join(count("left"), "left").join(count("right"), "right").selectExpr("left", "right", "bit_count(left ^ right) as distance", "left_n", "right_n")
