"""Tables: delimited text with an unknown delimiter, families of files, JSON lines, XML feeds; and what writes them."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions import checks
from ..functions.names import fresh
from . import files


def sniff_delimiter(head: str) -> str:
    """The delimiter among , ; tab | that parts the head's lines evenly and most; else the first of ; tab | , in the first line."""
    lines = [x for x in head.splitlines() if x.strip()][:20]
    best, most = "", 0
    for d in ",;\t|":
        counts = {x.count(d) for x in lines}
        if len(counts) == 1 and (n := counts.pop()) > most:
            best, most = d, n
    if best:
        return best
    return next((d for d in ";\t|," if lines and d in lines[0]), ",")


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lstrip("﻿").lower() for c in df.columns])


def read_delimited(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """Delimited text with header: delimiter from the first 4096 bytes, trimmed lower-case names, another delimiter tried if
    one column comes out. Raises when required columns are missing."""
    head = files.read_head(spark, path)
    first = sniff_delimiter(head)
    df = None
    for d in dict.fromkeys([first, *";\t|,"]):
        df = normalize_columns(spark.read.csv(path, header=True, sep=d, multiLine=True, escape='"'))
        if len(df.columns) > 1 or not required:
            break
    if missing := [c for c in required or [] if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def read_parts(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """The parts that exist, concatenated."""
    there = [f"{folder}/{n}" for n in names if files.exists(spark, f"{folder}/{n}")]
    if not there:
        raise FileNotFoundError(f"none of {names} in {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.csv(p, header=True, multiLine=True, escape='"') for p in there])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped, a missing file is an empty table."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_config(spark: SparkSession, path: str, required: list[str]) -> dict:
    data = json.loads(files.read_head(spark, path, 1 << 20))
    if missing := [k for k in required if k not in data]:
        raise ValueError(f"{path} lacks {missing}")
    return data


def read_feed(spark: SparkSession, path: str, until: str = "2014-12-31", least_words: int = 0) -> DataFrame:
    """(id, title, summary, published) of the entries of an Atom file up to a day."""
    from ..functions.text import squeeze, word_count

    schema = "id string, title string, summary string, published string"
    df = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    out = df.select("id", squeeze(F.col("title")).alias("title"), squeeze(F.col("summary")).alias("summary"), "published")
    return out.where((F.substring("published", 1, 10) <= until) & (word_count(F.col("summary")) >= least_words))


def useful_comments(df: DataFrame, score: str = "score", text: str = "text") -> DataFrame:
    from ..functions.text import word_count

    return df.where((F.col(score) > 5) & (word_count(F.col(text)) >= 200))


def jsonify(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, ArrayType | MapType | StructType)})


MANIFEST = ("path", "category", "label", "split", "group_id", "dataset_id", "domain", "label_mapping")


def write_csv(df: DataFrame, path: str, escape: str | None = None) -> None:
    """CSV with header, also when there are no rows: one empty partition writes it."""
    out = df.coalesce(1) if df.isEmpty() else df
    out.write.mode("overwrite").csv(path, header=True, **({"escape": escape} if escape else {}))


def write_manifest(df: DataFrame, path: str, columns: tuple[str, ...] = MANIFEST) -> None:
    lack = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
    write_csv(df.withColumns(lack).select(*columns) if lack else df.select(*columns), path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_in_place(df: DataFrame, path: str, backup: bool = True) -> None:
    """Write beside the path, then swap; the old table stays as .bak if asked. df may read the path."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".new")
    files.delete(spark, path + ".bak")
    if files.exists(spark, path):
        files.rename(spark, path, path + ".bak")
    files.rename(spark, path + ".new", path)
    if not backup:
        files.delete(spark, path + ".bak")


def write_dual(df: DataFrame, raw: str, cleaned: str, columns: tuple[str, ...] = ("text", "is_generated")) -> None:
    """All columns to one place, the canonical ones to another, from one computation."""
    kept = df.persist()
    try:
        kept.write.mode("overwrite").parquet(raw)
        kept.select(*columns).write.mode("overwrite").parquet(cleaned)
    finally:
        kept.unpersist()


def quarantine_plan(bad: DataFrame, root: str, quarantine: str) -> DataFrame:
    """(src, dst, reason): moves that keep the layout below root. Nothing is moved."""
    rest = F.expr(f"substring(path, {len(root.rstrip('/')) + 1})")
    return bad.select(F.col("path").alias("src"), F.concat(F.lit(quarantine.rstrip("/")), rest).alias("dst"), "reason")


#: Rows that a report may have; a longer table belongs into a file of its own.
REPORT_ROWS = 10_000


def _report_rows(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; write the table instead")
    return rows


def report_markdown(title: str, df: DataFrame) -> str:
    """A small result as a Markdown table."""
    rows = [tuple("" if v is None else str(v) for v in r) for r in _report_rows(df)]
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows]) + "\n"


def report_json(df: DataFrame) -> str:
    return json.dumps([r.asDict(recursive=True) for r in _report_rows(df)], default=str, sort_keys=True)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    """What save_model wrote: a fitted pipeline with its vocabulary, weights and labels."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def assign_labels(df: DataFrame, mapping: dict[str, int], allow_unknown: bool = False, category: str = "category") -> DataFrame:
    """Add label from the category; reading a row of an unknown one is an error, or it gets label -1 and split skipped_unknown."""
    from ..functions.labels import map_value

    out = df.withColumn("label", map_value(F.col(category), mapping))
    if not allow_unknown:
        return checks.no_row(out, F.col("label").isNull(), "unknown category ", F.col(category))
    split = F.col("split") if "split" in df.columns else F.lit(None).cast("string")
    return out.withColumns({"split": F.when(F.col("label").isNull(), "skipped_unknown").otherwise(split), "label": F.coalesce("label", F.lit(-1))})


def eval_manifest(listing: DataFrame, mapping: dict[str, int], split: str, root: str = "/app/data", there: DataFrame | None = None) -> DataFrame:
    """A manifest with one split from (image_name, category, ...); reading a file that is not in the listing `there` (path) is an error."""
    path = F.concat_ws("/", F.lit(root), "category", "image_name")
    out = assign_labels(listing, mapping).withColumns({"path": path, "split": F.lit(split), "label_mapping": F.lit(json.dumps(mapping, sort_keys=True))})
    if there is None:
        return out
    (seen,) = fresh(out, "seen")
    known = there.select(F.col("path").alias(seen)).distinct()
    return checks.no_row(out.join(known, out["path"] == known[seen], "left"), F.col(seen).isNull(), "listed, but not there: ", F.col("path")).drop(seen)


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt over all cores where its files have fewer splits than that, as one small file has: for work that takes longer
    than moving the rows. A scan of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
