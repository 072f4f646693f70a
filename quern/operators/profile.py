"""Profiles: counts, distributions, tables of frequencies and reports of what cleaning changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _stats(c: Column, name: str) -> list[Column]:
    return [F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}"), F.round(F.avg(c), 6).alias(f"mean_{name}"), F.median(c).alias(f"median_{name}")]


def corpus_profile(df: DataFrame, text: str = "text", label: str = "is_generated", by: str | None = None) -> DataFrame:
    """Rows, classes and shares, nulls, duplicate texts, word and character statistics, mean words by class. With `by` one row for
    each value and one (null) for all; the totals come from a rollup."""
    w = T.word_count(F.col(text))
    y = F.col(label)
    rows = df.withColumns({"__w": w, "__c": F.length(text), "__h": F.xxhash64(text)})
    aggs = [
        F.count("*").alias("rows"),
        F.count_if(y == 1).alias("ai_rows"),
        F.count_if(y == 0).alias("human_rows"),
        F.count_if(y.isNull() | ~y.isin(0, 1)).alias("other_rows"),
        F.round(F.count_if(y == 1) * 100.0 / F.count("*"), 2).alias("ai_percent"),
        F.round(F.count_if(y == 0) * 100.0 / F.count("*"), 2).alias("human_percent"),
        F.count_if(F.col(text).isNull()).alias("null_texts"),
        F.count_if(y.isNull()).alias("null_labels"),
        (F.count("*") - F.count_distinct(F.struct("__h"))).alias("duplicate_texts"),
        *_stats(F.col("__w"), "words"),
        *_stats(F.col("__c"), "chars"),
        F.round(F.avg(F.when(y == 1, F.col("__w"))), 6).alias("ai_mean_words"),
        F.round(F.avg(F.when(y == 0, F.col("__w"))), 6).alias("human_mean_words"),
    ]
    return rows.rollup(by).agg(*aggs) if by else rows.agg(*aggs)


def word_stats(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    w = T.word_count(F.col(text))
    return df.select(by, w.alias("__w")).groupBy(by).agg(F.count("*").alias("rows"), *_stats(F.col("__w"), "words"), F.round(F.stddev_samp("__w"), 6).alias("std_words"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, std, min, quartiles (interpolated), max."""
    v = F.col(value)
    q = F.expr(f"percentile(`{value}`, array(0.25, 0.5, 0.75))")
    return df.agg(F.count(v).alias("count"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.min(v).alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(v).alias("max"))


def frequencies(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def class_shares(df: DataFrame, label: str, text: str = "text") -> DataFrame:
    """Each class's rows, share in percent and word statistics."""
    total = df.agg(F.count("*").alias("__t"))
    per = word_stats(df, label, text)
    return per.crossJoin(total).withColumn("percent", F.round(F.col("rows") * 100.0 / F.col("__t"), 2)).drop("__t")


def storage_profile(df: DataFrame) -> DataFrame:
    """(file, rows, bytes) of a file-backed frame."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).groupBy("file").agg(F.count("*").alias("rows"), F.first("size").alias("bytes"))


def step_report(df: DataFrame, text: str, steps: list[tuple[str, object]]) -> DataFrame:
    """(step, changed): how many rows each cleaning step changes, in order, in one pass."""
    now, flags = F.col(text), []
    frame = df.select(now.alias("__0"))
    for k, (name, step) in enumerate(steps):
        frame = frame.withColumn(f"__{k + 1}", step(F.col(f"__{k}")))
        flags.append(F.count_if(F.col(f"__{k + 1}") != F.col(f"__{k}")).alias(name))
    pairs = ", ".join(f"'{n}', `{n}`" for n, _ in steps)
    return frame.agg(*flags).selectExpr(f"stack({len(steps)}, {pairs}) as (step, changed)")


def mean_std(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and population deviation over folds."""
    return df.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))


def partitions(df: DataFrame) -> int:
    """As many parts as the input has splits or a shuffle has parts, whichever are more, so that a part is no larger than a split."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def top_words(df: DataFrame, key: str, text: str = "text", k: int = 3) -> DataFrame:
    """(key, word, n, rank): each text's most frequent words, ties by word. Texts are shuffled by key, and their words not at all."""
    texts = df.select(key, text).repartition(partitions(df), key)
    counts = texts.select(key, F.explode(T.words(F.lower(F.col(text)))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)


def holdout_aggregate(long: DataFrame) -> DataFrame:
    """(run, metric, mean, worst, total, completed) of (run, holdout, metric, value); a null value is a holdout not completed."""
    return long.groupBy("run", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("worst"), F.count("*").alias("total"), F.count("value").alias("completed"))


def last_epoch(log: DataFrame, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """The last row of each run's training log."""
    return log.groupBy(run).agg(F.max_by(F.struct(*log.columns), epoch).alias("r")).select("r.*")


def first_known(df: DataFrame, column: str) -> str | None:
    """One known value of a column as text, the least, so that it does not depend on the order of rows; None without column or value."""
    if column not in df.columns:
        return None
    return df.agg(F.min(F.col(column).cast("string"))).first()[0]
