"""File helpers through Hadoop's file systems, so that any store Spark reads works."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import fresh


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_head(spark: SparkSession, path: str, n: int = 4096) -> str:
    """The first n bytes of a file as text, without a byte order mark."""
    p, fs = _path(spark, path)
    if fs.getFileStatus(p).isDirectory():
        files = sorted(str(s.getPath()) for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))
        if not files:
            return ""
        p, fs = _path(spark, files[0])
    stream = fs.open(p)
    try:
        size = min(n, fs.getFileStatus(p).getLen())
        data = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) if size else b""
    finally:
        stream.close()
    return data.decode("utf-8-sig", "ignore")


def rename(spark: SparkSession, source: str, target: str) -> None:
    a, fs = _path(spark, source)
    b, _ = _path(spark, target)
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


IMAGE_TYPES = ("png", "jpg", "jpeg", "bmp", "gif")
IMAGE_TYPES_MORE = (*IMAGE_TYPES, "webp")


def list_files(spark: SparkSession, path: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """(path, length, modified) of all files below a folder, contents not read; filtered by extension in any case.

    Spark hides files and folders whose names begin with _ or a dot."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    if types:
        df = df.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*types))
    return df


def image_listing(spark: SparkSession, path: str, skip: tuple[str, ...] = ("_unsorted",)) -> DataFrame:
    """(image_name, category): the category is the file's folder."""
    df = list_files(spark, path, IMAGE_TYPES)
    parts = F.split("path", "/")
    return df.select(F.element_at(parts, -1).alias("image_name"), F.element_at(parts, -2).alias("category")).where(~F.col("category").isin(*skip)).orderBy("category", "image_name")


def images(spark: SparkSession, path: str) -> DataFrame:
    """All image files below a folder, by path."""
    return list_files(spark, path, IMAGE_TYPES_MORE).orderBy("path")


def text_tree(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) of a tree of text files: the label is the folder human or ai on the way, human first; files under
    neither, and empty ones, are left out. Bytes that are no UTF-8 are dropped."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    parts = F.transform(F.split("path", "/"), F.lower)
    label = F.when(F.array_contains(parts, "human"), "human").when(F.array_contains(parts, "ai"), "ai")
    text = F.regexp_replace(F.expr("make_valid_utf8(cast(content as string))"), "�", "")
    return df.select(text.alias("text"), label.alias("label")).where("label is not null and trim(text) <> ''")


def latest(listing: DataFrame, suffix: str) -> DataFrame:
    """The newest file whose name ends with suffix, as one row (path, modified); ties by path."""
    return listing.where(F.col("path").endswith(suffix)).agg(F.max_by(F.struct("path", "modified"), F.struct("modified", "path")).alias("f")).where("f is not null").select("f.path", "f.modified")


def best_candidate(listing: DataFrame, extensions: list[str], names: list[str]) -> DataFrame:
    """One file: by the order of its extension, then of the first name it contains, then by size, the largest first."""
    rank, by_name = fresh(listing, "e", "n")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ext, known = F.lit(len(extensions)), F.lit(len(names))
    for k in reversed(range(len(extensions))):
        ext = F.when(name.endswith("." + extensions[k]), k).otherwise(ext)
    for k in reversed(range(len(names))):
        known = F.when(name.contains(names[k]), k).otherwise(known)
    return listing.withColumns({rank: ext, by_name: known}).where(F.col(rank) < len(extensions)).orderBy(rank, by_name, F.desc("length"), "path").limit(1).drop(rank, by_name)


def choose_item_file(listing: DataFrame, by: str, name: str = "name", size: str = "size") -> DataFrame:
    """Of each item the largest plain text file between 5 kB and 2 MB that is no scanner's by-product."""
    ok = F.lower(name).endswith(".txt") & ~F.lower(name).rlike(r"(_djvu|_ocr|_hocr|_abbyy|_meta|_page_numbers)") & F.col(size).between(5_000, 2_000_000)
    return listing.where(ok).groupBy(by).agg(F.max_by(F.struct(*listing.columns), F.struct(size, name)).alias("f")).select("f.*")


def middle_text(text, share: float = 0.6, most: int = 8000):
    """The middle `share` of a text, its first `most` characters."""
    cut = int(round((1 - share) / 2 * 100))
    n = F.length(text)
    start = F.floor(n * cut / 100)
    return F.substring(F.substring(text, F.lit(1) + start.cast("int"), (n - 2 * start).cast("int")), F.lit(1), F.lit(most))


def first_long_enough(columns, least: int = 200):
    """Of several bodies fetched for one item the first that is a text of at least `least` characters; null without one."""
    return F.coalesce(*[F.when(F.length(c) >= least, c) for c in map(F.col, columns)])


def present_or_load(spark: SparkSession, path: str, loaders) -> DataFrame:
    """The table at path if it has files; else the first loader that works is written there, lists and structs as JSON texts. The
    last loader's error is raised when none does."""
    from pyspark.errors import PySparkException

    if not exists(spark, path):
        error: Exception = ValueError("no loaders")
        for load in loaders:
            try:
                df = load()
                nested = {c: F.to_json(c) for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))}
                df.withColumns(nested).write.mode("overwrite").parquet(path) if nested else df.write.mode("overwrite").parquet(path)
                break
            except (PySparkException, OSError) as e:
                error = e
        else:
            raise error
    return spark.read.parquet(path)


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder's path below the one named in spark.checkpoint.dir, which all executors share; below one of this process's own
    in local mode where that is unset, removed at its end."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_folder()
    return f"{found.rstrip('/')}/quern-work/{label}-{uuid.uuid4().hex}"


@functools.cache
def _own_folder() -> str:
    made = tempfile.mkdtemp(prefix="quern-work-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + made


def written(df: DataFrame, label: str) -> DataFrame:
    """df written into a new folder of the workspace and read back: what reads it does not compute it again."""
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
