"""What the training-data operators share: tables cut into the shared folder, document groups and connected components."""

from __future__ import annotations

import atexit
import contextlib
import functools
import math
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw text in one group of documents, the unit that one Python call holds in memory.
GROUP_BYTES = 6_000_000
#: A corpus is dealt into no fewer groups than this, so that small inputs still spread over the cluster.
LEAST_GROUPS = 64

#: Rows of an Arrow batch whose texts one Python call holds as objects at a time.
SLICE = 500

#: Staged tables, per thread: a stack with a list of (path, table) for each open scope(), and one below for those of none.
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only in local mode when it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    """Made once a process and removed at its end."""
    made = tempfile.mkdtemp(prefix="quern-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + made


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends here and lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables().append((path, out))
    return out


def _tables() -> list[tuple[str, DataFrame]]:
    if not hasattr(_open, "stack"):
        _open.stack = [[]]
    return _open.stack[-1]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """with scope() as keep: the staged tables made inside by this thread are deleted at its end, but for those given to
    keep(), which belong to the scope around it."""
    _tables()
    mine, kept = [], []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _open.stack.append(mine)
    try:
        yield keep
    finally:
        _open.stack.remove(mine)
        for path, df in mine:
            if any(df is k for k in kept):
                _tables().append((path, df))
            else:
                _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete the staged tables that this thread still holds; call it when the results that read them are written."""
    while _tables():
        _delete(spark, _tables().pop()[0])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns that no column of df has; upper and lower case count as one, as they do in plans."""
    taken, mark = {c.lower() for c in df.columns}, "__quern_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grouped(docs: DataFrame, short: int, group_bytes: int = GROUP_BYTES, least: int = LEAST_GROUPS) -> tuple[DataFrame, DataFrame, int, int]:
    """(g, doc_id, text) with g dealing documents into groups of about group_bytes; (doc_id, text) of the texts of fewer than
    `short` bytes, nulls among them; the number of groups; the bytes in all.

    g hashes both id and text, so null or repeated ids and hot sources spread evenly, and a task that runs again deals its rows as
    before, in whatever order it reads them. Short texts, of which a table may have very many equal ones, have nothing to be compared
    and stay out of the groups.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    n = max(least, math.ceil(size / group_bytes))
    is_short = F.coalesce(F.octet_length("text"), F.lit(0)) < short
    return base.where(~is_short).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("g"), "doc_id", "text"), base.where(is_short), n, size


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): root is the least node reachable over edges (a, b); nodes without an edge are absent.

    Alternating large-star and small-star rounds; each round is a written table, so nothing is collected
    and a star with a hot centre only meets partial aggregates and joins that can split it. Joins are by shuffle, as each
    round's broadcasts would pass through the driver.
    """
    now = stage(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        label,
    )
    seen = _digest(now)
    while seen[0]:
        with scope() as keep:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            new = keep(stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label))
            got = _digest(new)
        drop(now)  # the round before is no longer read by anything
        now = new
        if got == seen:
            break
        seen = got
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def kept_rows(docs: DataFrame, best: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of docs that best names by (doc_id, text_hash), one of each; again has those of best that docs has several times."""
    same = lambda a, b: F.expr(f"{a}.doc_id <=> {b}.doc_id and xxhash64(cast({a}.text as string)) = {b}.text_hash")
    kept = docs.alias("d").join(best.alias("k"), same("d", "k"), "left_semi")
    if again.isEmpty():
        return kept
    rest = kept.alias("d").join(again.alias("a"), same("d", "a"), "left_anti")
    one = kept.alias("d").join(again.alias("a"), same("d", "a"), "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.unionByName(one)


def drop(df: DataFrame) -> None:
    """Delete one staged table of the open scope."""
    for x in [x for x in _tables() if x[1] is df]:
        _tables().remove(x)
        _delete(df.sparkSession, x[0])


def _digest(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


# Packed cells: sorted distinct integers as their steps, of 2 bytes or, where steps are wide, 4; a first byte says which.
# The largest value of the type means "that many more, no cell here".


def pack_cells(cells: np.ndarray) -> bytes:
    kind = np.uint16 if not len(cells) or int(cells[-1]) < 16000 * len(cells) else np.uint32
    most = np.uint64(np.iinfo(kind).max)
    steps = np.diff(cells.astype(np.uint64), prepend=np.uint64(0))
    more, rest = np.divmod(steps, most)
    out = np.full(int(more.sum()) + len(cells), most, kind)
    out[np.cumsum(more.astype(np.int64) + 1) - 1] = rest
    return bytes([out.itemsize]) + out.tobytes()


def unpack_cells(data: bytes) -> np.ndarray:
    kind = np.uint16 if data[0] == 2 else np.uint32
    steps = np.frombuffer(data, kind, offset=1)
    return np.cumsum(steps, dtype=np.uint64)[steps != np.iinfo(kind).max]


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark gives Python functions SLICE rows at a time at most, so that both sides' buffers of whole texts stay small; results
    do not depend on it. Holds for what runs inside; the session's own setting is back at the end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, SLICE if int(own) <= 0 else min(SLICE, int(own)))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def slices(batch):
    """An Arrow batch or array in parts of SLICE rows, without copying: what is made of the texts is held for a part at a time."""
    for at in range(0, len(batch), SLICE):
        yield batch.slice(at, SLICE)


def bits_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer, so that any bits of h serve as a bucket."""
    h = h ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def rolling(h: np.ndarray, k: int, m: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash of each k consecutive entries, by doubling: log2 k passes. Length len(h) - k + 1, or none."""
    if len(h) < k:
        return h[:0]
    out, done, width, power, base = None, 0, 1, m, h
    while True:
        if k & width:
            part = base[done : done + len(h) - k + 1]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += width
        if width * 2 > k:
            return out
        base = base[:-width] * np.uint64(power) + base[width:]
        power, width = power * power & (2**64 - 1), width * 2


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Flags of the n places covered by [s, s + width) for any of the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def rows(lists: Sequence[Iterable], schema) -> "object":
    import pyarrow as pa

    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(lists, schema)], schema=schema)
