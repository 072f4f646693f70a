"""Random numbers without state: a draw follows from a key, a stream and a counter, so rows get the same numbers in whatever order
and partitions they are read, and any row's can be told without the others'.

A draw mixes 31-bit numbers by multiplication modulo a prime and by folding high bits onto low ones; products stay below 2^62, so nothing
overflows under ANSI rules and any SQL engine with 64-bit integers gives the same numbers.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The modulus, and multipliers that are primitive roots of it.
PRIME, FIRST, SECOND = 2_147_483_647, 1_583_458_089, 784_588_716


def round_keys(*what) -> tuple[int, int]:
    """Two numbers below PRIME that follow from seed, epoch, stream or whatever names a sequence."""
    h = hashlib.sha256(":".join(map(str, what)).encode()).digest()
    return int.from_bytes(h[:8], "big") % PRIME, int.from_bytes(h[8:16], "big") % PRIME


def mixed(x: Column, one: Column | int, two: Column | int) -> Column:
    """A number from 0 to PRIME for x, one and two, each of them from 0 to PRIME."""
    one, two = (F.lit(k).cast("long") if isinstance(k, int) else k for k in (one, two))
    y = (x * F.lit(FIRST) + one) % F.lit(PRIME)
    z = (y.bitwiseXOR(F.shiftright(y, 15)) * F.lit(SECOND) + two) % F.lit(PRIME)
    return z.bitwiseXOR(F.shiftright(z, 13))


def mixed_sql(x: str, one: int | str, two: int | str) -> str:
    """mixed() in SQL with xor(), >> and %."""
    y = f"((({x}) * {FIRST} + {one}) % {PRIME})"
    z = f"((xor({y}, {y} >> 15) * {SECOND} + {two}) % {PRIME})"
    return f"xor({z}, {z} >> 13)"


def mixed_py(x: int, one: int, two: int) -> int:
    """mixed() of numbers."""
    y = (x * FIRST + one) % PRIME
    z = ((y ^ y >> 15) * SECOND + two) % PRIME
    return z ^ z >> 13


def row_key(key: Column, *what) -> Column:
    """struct(one, two): what a row's draws begin with. key: any whole number; text keys go through crc32 or a hash first."""
    low = F.pmod(key.cast("long"), F.lit(PRIME))
    high = F.pmod(F.shiftright(key.cast("long"), 31), F.lit(PRIME))
    a, b = round_keys(*what, "one"), round_keys(*what, "two")
    return F.struct(mixed(low, (high + a[0]) % F.lit(PRIME), a[1]).alias("one"), mixed(low, (high + b[0]) % F.lit(PRIME), b[1]).alias("two"))


def uniform(row: Column, stream: str, counter: Column | int = 0) -> Column:
    """In [0, 1), for a row_key(), a stream's name and a counter below PRIME, such as a pixel's place."""
    a, b = round_keys("stream", stream)
    counter = F.lit(counter) if isinstance(counter, int) else counter
    return mixed(counter.cast("long"), (row["one"] + F.lit(a)) % F.lit(PRIME), (row["two"] + F.lit(b)) % F.lit(PRIME)) / F.lit(float(2**31))


def between(row: Column, stream: str, low, high, counter: Column | int = 0) -> Column:
    return low + uniform(row, stream, counter) * (high - low)


def normal(row: Column, stream: str, counter: Column | int = 0) -> Column:
    """Normal numbers of mean 0 and deviation 1, from two uniform ones."""
    u, v = uniform(row, stream + ":radius", counter), uniform(row, stream + ":angle", counter)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)
