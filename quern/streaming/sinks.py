"""Sinks for foreachBatch: a log that takes each record once, and a baseline that is pinned once."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance
from ..sources import files

#: Columns that a log's folders are named by.
PLACE = ("day", "writer", "batch")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a log and where they lie: day, writer, batch. A log that is not there has none."""
    whole = f"{schema}, day date, writer string, batch bigint"
    if not files.exists(spark, path):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).json(path)


def append_once(rows: DataFrame, batch: int, path: str, keys: list[str], writer: str, ts: str) -> None:
    """Append rows to the log at path as JSON lines in day=/writer=/batch= folders.

    A batch that comes again writes its own folders anew, and a record that another batch or writer has on that day is left out
    by an anti-join over the batch's days only; so each key is there once, however often batches are replayed. Of equal keys in
    a batch one is taken, the least as JSON. Two writers that bring the same new key at the same moment may both write it: give them
    keys of their own. Keys compare nulls as equal; rows without a time have none of the days and lie under a day of their own.
    """
    spark = rows.sparkSession
    names = [f.name for f in rows.schema]
    if clash := [n for n in names if n.lower() in PLACE]:
        raise ValueError(f"columns {clash} name a log's folders")
    day = F.to_date(F.col(ts))
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("r")).select("r.*").withColumn("day", day)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    known = read_log(spark, path, schema).where(~((F.col("writer") == writer) & (F.col("batch") == batch)))
    span = one.agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count_if(F.col("day").isNull()).alias("n")).first()
    if span["a"] is None and not span["n"]:
        return
    days = F.col("day").between(F.lit(span["a"]), F.lit(span["b"])) if span["a"] else F.lit(False)
    if span["n"]:
        days = days | F.col("day").isNull()
    same = lambda c: F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    on = [same(c) for c in (*keys, "day")]
    new = one.alias("l").join(known.where(days).alias("r"), on, "left_anti")
    out = new.withColumns({"writer": F.lit(writer), "batch": F.lit(batch).cast("long")})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).json(path)


def pin_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file at path with a text unless it is there; True for the one caller that did. The text is written beside it
    first, so no reader sees half of it. One of several callers wins on local disks (by a hard link) and on file systems whose
    rename is atomic and refuses an existing target; object stores without such a rename cannot tell two callers apart."""
    if files.exists(spark, path):
        return False
    aside = f"{path}.{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(aside)
    fs = at.getFileSystem(conf)
    stream = fs.create(at, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(urlparse(aside).path, urlparse(path).path)
            except FileExistsError:
                return False
            return True
        return bool(fs.rename(at, jvm.org.apache.hadoop.fs.Path(path)))
    finally:
        fs.delete(at, False)


REQUEST_KEYS = ["timestamp", "user_id", "eval_split", "tuning_split"]


def governed(config: governance.Config, log: str, baseline: str, writer: str):
    """A function for foreachBatch over requests (see governance.decide, and timestamp, user_id and the artifacts' hashes): it
    decides them, appends the records once, and pins the hashes of the first allowed and valid request without override, in the
    order of time and user, if no baseline is there. Requests of a batch do not see the baseline that it pins."""
    columns = [*REQUEST_KEYS, "allowed", "valid", "reason", "override", *governance.ARTIFACTS]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        lacking = {c: F.lit(None).cast("string") for c in governance.ARTIFACTS if c not in batch.columns}
        decided = governance.decide(batch.withColumns(lacking) if lacking else batch, config).persist()
        try:
            append_once(decided.select(*columns), batch_id, log, REQUEST_KEYS, writer, "timestamp")
            if not files.exists(spark, baseline):
                free = decided.where(F.col("allowed") & F.col("valid") & ~F.coalesce("override", F.lit(False)))
                first = free.orderBy("timestamp", "user_id").select("timestamp", "user_id", *governance.ARTIFACTS).limit(1).collect()
                if first:
                    pin_once(spark, baseline, json.dumps(first[0].asDict() | {"writer": writer, "batch": batch_id}, sort_keys=True, default=str))
        finally:
            decided.unpersist()

    return run
