"""Training epochs over a table: seeded order without a sort, shards of equal size, resuming at a place, bad rows counted and left out.

The order of an epoch is a keyed permutation of row numbers, so a row's place follows from its number alone: a narrow plan, whatever the
table's size. The permutation is a Feistel network over pairs of numbers (left below `a`, right below `b`, a * b just above the number
of rows), walked again while it leads beyond the last row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import PRIME, mixed, round_keys
from ..functions.names import fresh

#: Rounds of the network, an even number; walks after which a row is given up with an error. A walk leads beyond the last row with a
#: chance of one in the square root of the number of rows, and small tables need no more walks than this.
ROUNDS, WALKS = 6, 20


def sides(n: int) -> tuple[int, int]:
    """(a, b) with a * b at least n, and less than n + a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, -(-max(n, 1) // a)


def position(row: Column, n: int, seed: int, epoch: int) -> Column:
    """The place, from 0, of row number `row` (0 to n - 1) in an epoch of n rows; null for numbers that are none."""
    if n > PRIME**2:
        raise ValueError("too many rows")
    a, b = sides(n)
    keys = F.array(*[F.struct(*[F.lit(k).cast("long").alias(c) for k, c in zip(round_keys(seed, epoch, r), ("one", "two"))]) for r in range(ROUNDS)])
    long = lambda v: F.lit(v).cast("long")

    def walk(x: Column) -> Column:
        # each round adds what one half is mixed to onto the other, and changes sides
        start = F.struct(F.call_function("div", x, long(b)).alias("u"), (x % long(b)).alias("v"), long(a).alias("m"), long(b).alias("w"))
        step = lambda s, k: F.struct(s["v"].alias("u"), ((s["u"] + mixed(s["v"], k["one"], k["two"])) % s["m"]).alias("v"), s["w"].alias("m"), s["m"].alias("w"))
        return F.aggregate(keys, start, step, lambda s: s["u"] * long(b) + s["v"])

    number = F.when((row >= 0) & (row < n), row.cast("long"))
    found = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), walk(number), lambda x, _: F.when(x < n, x).otherwise(walk(x)))
    return F.when(found < n, found).when(found.isNotNull(), F.raise_error(F.lit("no place found; take another seed")).cast("long"))


def numbered(spark: SparkSession, path: str, out: str = "row") -> DataFrame:
    """A written Parquet table with dense row numbers from 0, in the order of files and of rows in them: one count over the files' rows,
    no sort. The numbers stay the same as long as the files do."""
    df = spark.read.parquet(path)
    file, index, before = fresh(df, "file", "index", "before")
    placed = df.withColumns({file: F.col("_metadata.file_path"), index: F.col("_metadata.row_index")})
    sizes = placed.groupBy(file).agg(F.count("*").alias(before))  # a row a file
    ahead = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(file, F.coalesce(F.sum(before).over(ahead), F.lit(0)).alias(before))
    return placed.join(starts, file).withColumn(out, F.col(before) + F.col(index)).select(*df.columns, out)


def epoch(df: DataFrame, n: int, seed: int, number: int, row: str = "row", shards: int = 1, batch: int = 32, start: int = 0, drop_last: bool = False) -> DataFrame:
    """df with shard, place (from 0 in the shard) and batch (from 0 in the shard) of epoch `number`, from place `start` on.

    Row numbers are 0 to n - 1, each once; a row without such a number has no place and is left out. Shards differ by one row at the most;
    drop_last leaves the rows out that do not fill a batch in every shard, so that all shards have as many."""
    at, *_ = fresh(df, "position")
    placed = df.withColumn(at, position(F.col(row), n, seed, number)).withColumns({"shard": (F.col(at) % shards).cast("int"), "place": F.call_function("div", F.col(at), F.lit(shards)).cast("long")})
    placed = placed.where(F.col("place") >= start).withColumn("batch", F.call_function("div", F.col("place"), F.lit(batch)).cast("long"))
    if drop_last:
        placed = placed.where(F.col("place") < n // shards // batch * batch)
    return placed.drop(at)


def dealt(df: DataFrame, shards: int) -> DataFrame:
    """Each shard in a partition of its number, in order: one shuffle, and sorts of a shard each."""
    return df.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place")


def counted(df: DataFrame, good: Column, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The rows for which `good` holds, and how many were good and bad, known when the one job that reads them is done; a null is bad."""
    seen = Observation(name)
    (mark,) = fresh(df, "good")
    marked = df.withColumn(mark, F.coalesce(good, F.lit(False)))
    return marked.observe(seen, F.count_if(mark).alias("good"), F.count_if(~F.col(mark)).alias("bad")).where(mark).drop(mark), seen
