"""Near hashes against all pairs, with bands that a third of the hashes share."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import hashes


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def links_by_definition(values, radius):
    """(left, right, distance) over all pairs of different values, in blocks."""
    v = np.array(sorted(map(signed, set(values))), np.int64)
    out = set()
    for k in range(len(v)):
        d = np.bitwise_count((v[k] ^ v[k + 1 :]).view(np.uint64))  # of signed numbers it would count the absolute value
        for j in np.flatnonzero(d <= radius):
            out.add((int(v[k]), int(v[k + 1 + j]), int(d[j])))
    return out


def family(draw, n, hot_bits=0):
    """Random hashes, near copies of some, and a third that share a band's bits."""
    values = [draw.getrandbits(64) for _ in range(n)]
    for v in values[: n // 4]:
        for k in (1, 4, 8, 9):
            values.append(v ^ sum(1 << b for b in draw.sample(range(64), k)))
    if hot_bits:
        top = 0xBEEF << 48
        shared = [top | draw.getrandbits(64 - hot_bits) for _ in range(len(values) // 2)]
        shared += [v ^ sum(1 << b for b in draw.sample(range(64), 6)) for v in shared[: n // 10]]
        values += shared
    return values


@pytest.mark.parametrize("radius", [0, 1, 3, 5, 8])
def test_all_pairs(spark, radius):
    values = family(random.Random(radius), 300) + [0, 2**64 - 1, 1 << 63, (1 << 63) | 1]
    df = spark.createDataFrame([(signed(v),) for v in values] + [(None,), (signed(values[0]),), (signed(values[0]),)], "ahash long")
    got = hashes.near_links(df, radius=radius).collect()
    assert sorted((r["left"], r["right"], r["distance"]) for r in got) == sorted(links_by_definition(values, radius))
    counts = {signed(v): values.count(v) + 2 * (v == values[0]) for v in set(values)}
    assert all(r["left_n"] == counts[r["left"]] and r["right_n"] == counts[r["right"]] for r in got)
    assert hashes.near_links(df.where("false"), radius=radius).count() == 0


@pytest.mark.parametrize("limit", [40, 300])
def test_hot_band(spark, limit):
    values = family(random.Random(11), 700, hot_bits=16)
    df = spark.createDataFrame([(signed(v),) for v in values], "ahash long").repartition(5)
    assert {(r["left"], r["right"], r["distance"]) for r in hashes.near_links(df, radius=8, limit=limit).collect()} == links_by_definition(values, 8)


def test_no_group_grows_with_a_hot_band(spark):
    """A third of 6,000 hashes share 16 bits: no key above the limit is compared, and pairs that are compared stay far below all pairs."""
    values = set(family(random.Random(12), 1800, hot_bits=16))
    df = spark.createDataFrame([(signed(v),) for v in values], "h long")
    compared = worst = 0
    for rows, _ in hashes.levels(df, len(values), 8, 400):
        sizes = [r["count"] for r in rows.groupBy("key").count().collect()]
        worst = max([worst, *sizes])
        compared += sum(s * (s - 1) // 2 for s in sizes)
    assert worst <= 400 and compared < len(values) ** 2 / 2


def test_cuts():
    for n in (10, 10**4, 10**6, 10**9):
        for radius in range(0, 21):
            cut = hashes.bands(0, n, radius)
            assert sum(m for m, _ in cut) == 2**64 - 1 and sum(3 if t else 1 for _, t in cut) > radius
            assert sum(bin(m).count("1") for m, _ in cut) == 64
    assert len(hashes.bands(0, 100, 8)) > len(hashes.bands(0, 10**8, 8)) == 3
    assert hashes.bands(2**64 - 1, 10, 3) == ()


def test_radius_is_checked(spark):
    with pytest.raises(ValueError):
        hashes.near_links(spark.range(1).select(F.col("id").alias("ahash")), radius=21)
