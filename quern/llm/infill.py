"""Fill-in-the-middle: a text is cut into prefix, middle and suffix at two unit boundaries and put in another order.

Boundaries are a bit vector over the text's bytes, packed eight to a byte, with a directory of the ones before each block. The
directory's last entry says how many units there are; a seeded draw from that number names two units, and select finds the byte
behind each of them: the directory gives the block by bisection, popcounts the byte in it. A second vector over the bytes that
begin a code point turns byte cuts into lengths in characters by rank. Units are never built.

Draws come from the hash of seed and id, so a row's form depends on nothing else and repeated ids get equal draws. A text that is
empty or holds a mark stays plain, as its parts could not be told apart again. restore() undoes the change from output and form alone.

Each row is changed alone: a narrow map. Null texts are empty, a null id is written as the empty string, repeated rows pass
through, an empty table gives no rows, ties do not arise. Very long texts take some three times their bytes. Other columns stay,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Seed of the draws; percentage of texts that are changed; percentage of those that begin with the suffix.
SEED, RATE, SUFFIX_FIRST = 7, 100, 50


class Bits:
    """A packed bit vector with rank and select. Blocks of 64 bytes, with the ones before each of them."""

    BLOCK = 64

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags)
        self.bits = np.zeros(-(-len(packed) // self.BLOCK) * self.BLOCK, np.uint8)
        self.bits[: len(packed)] = packed
        ones = np.bitwise_count(self.bits).reshape(-1, self.BLOCK).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: int) -> int:
        """Ones among the first `at` bits."""
        byte, bit = divmod(at, 8)
        block = byte // self.BLOCK
        n = int(self.before[block]) + int(np.bitwise_count(self.bits[block * self.BLOCK : byte]).sum(dtype=np.int64))
        return n + ((int(self.bits[byte]) >> (8 - bit)).bit_count() if bit else 0)

    def select(self, k: int) -> int:
        """Where the k-th one is, counted from 1."""
        block = int(np.searchsorted(self.before, k, "left")) - 1
        ones = np.cumsum(np.bitwise_count(self.bits[block * self.BLOCK : (block + 1) * self.BLOCK]), dtype=np.int64)
        k -= int(self.before[block])
        byte = int(np.searchsorted(ones, k, "left"))
        k -= int(ones[byte - 1]) if byte else 0
        at = block * self.BLOCK + byte
        return at * 8 + int(np.flatnonzero(np.unpackbits(self.bits[at : at + 1]))[k - 1])


def unit_ends(data: np.ndarray, unit: str) -> np.ndarray:
    """Flags of the bytes that end a unit; what follows the last line feed is a line too."""
    if unit == "lines":
        flags = data == 10
    else:  # a character ends where the next byte begins one
        flags = np.ones(len(data), bool)
        flags[:-1] = (data[1:] & 0xC0) != 0x80
    if len(flags):
        flags[-1] = True
    return flags


def draws(doc_id, seed: int = SEED) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(doc_id, data: bytes, unit: str = "lines", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output)."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    array = np.frombuffer(data, np.uint8)
    ends = Bits(unit_ends(array, unit))
    n = ends.total
    if not data or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, data
    a, b = ((ends.select(k) + 1 if k else 0) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    begins = Bits((array & 0xC0) != 0x80)
    chars = begins.rank(a)
    prefix, middle, suffix = PREFIX + data[:a], MIDDLE + data[a:b], SUFFIX + data[b:]
    form = "spm" if h4 % 100 < suffix_first else "psm"
    return n, form, chars, begins.rank(b) - chars, b"".join((suffix, prefix, middle) if form == "spm" else (prefix, suffix, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that transform had, from its output and form."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError(f"no output of form {form}")
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


_TYPES = {"long": pa.int64(), "string": pa.string()}
_FOUND = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string", "output_sha256": "string", "restored_sha256": "string"}


def fill_in_middle(docs: DataFrame, out: str = "fim", unit: str = "lines", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, texts: bool = True) -> DataFrame:
    """docs with a struct: n (units), form (plain, psm, spm), prefix_chars, middle_chars, output, and the hashes of the output and of
    the text that restore() makes of it. texts=False leaves the output null."""
    if unit not in ("lines", "characters"):
        raise ValueError("unit is 'lines' or 'characters'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(k, _TYPES[v]) for k, v in _FOUND.items()])
        for batch in batches:
            found = []
            for doc_id, text in zip(*(batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))):
                *head, output = transform(doc_id, (text or "").encode(), unit, rate, suffix_first, seed)
                restored = restore(output, head[1])
                found.append(dict(zip(_FOUND, (*head, output.decode() if texts else None, hashlib.sha256(output).hexdigest(), hashlib.sha256(restored).hexdigest()))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, kind)], [*batch.schema.names[:-2], out])

    i, t = fresh(docs, "id", "text")
    given = docs.withColumn(i, F.col("doc_id").cast("string")).withColumn(t, F.col("text").cast("string"))
    schema = docs.limit(0).withColumn(out, F.lit(None).cast("struct<" + ",".join(f"{k}:{v}" for k, v in _FOUND.items()) + ">")).schema
    return given.mapInArrow(run, schema)


def digest(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of (doc_id, text) without the texts."""
    df = fill_in_middle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), texts=False, **settings)
    return df.select("doc_id", "fim.*").drop("output")
