"""Profiles that grow by the day: for each day and source one row of counts, sums and mergeable sketches, kept as a table.

A profile of any days or sources is a merge of such rows and reads no text again. Quantiles come from a KLL sketch, whose rank error is
RANK_ERROR at its size with a probability of 99 %, and distinct texts from a HyperLogLog sketch with a standard error of DISTINCT_ERROR;
both stay so however many rows are merged. Sketches are Spark's own aggregates: partial aggregation sends a few kilobytes a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files

#: The sketches' sizes and what follows from them: 2.446 / size ** 0.9433 for KLL, 1.04 / sqrt(2 ** bits) for HyperLogLog.
KLL_SIZE, HLL_BITS = 800, 12
RANK_ERROR, DISTINCT_ERROR = 0.0045, 0.01625

_SUMS = ("rows", "ai_rows", "human_rows", "other_rows", "null_texts", "null_labels", "words", "chars", "ai_words", "human_words")
_RANGES = ("words", "chars")


def partials(df: DataFrame, *by: str, text: str = "text", label: str = "is_generated") -> DataFrame:
    """One row for each of `by`: counts and sums (integers), least and greatest words and characters, and the sketches."""
    y, t = F.col(label), F.col(text)
    rows = df.select(*by, y.alias("_y"), t.isNull().alias("_null"), T.word_count(t).cast("long").alias("_words"), F.length(t).cast("long").alias("_chars"), F.xxhash64(F.coalesce(t, F.lit("")), t.isNull()).alias("_hash"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    y, words = F.col("_y"), F.col("_words")
    sums = {
        "rows": F.count("*"), "ai_rows": count(y == 1), "human_rows": count(y == 0), "other_rows": count(y.isNull() | ~y.isin(0, 1)), "null_texts": F.count_if("_null"), "null_labels": count(y.isNull()),
        "words": total("_words"), "chars": total("_chars"), "ai_words": total(F.when(y == 1, words)), "human_words": total(F.when(y == 0, words)),
    }
    ranges = [f(f"_{c}").alias(f"{n}_{c}") for c in _RANGES for n, f in (("min", F.min), ("max", F.max))]
    sketches = [F.kll_sketch_agg_bigint(f"_{c}", F.lit(KLL_SIZE)).alias(f"{c}_sketch") for c in _RANGES]
    return rows.groupBy(*by).agg(*[v.alias(n) for n, v in sums.items()], *ranges, *sketches, F.hll_sketch_agg("_hash", F.lit(HLL_BITS)).alias("texts_sketch"))


def add_days(df: DataFrame, path: str, day: str = "day", by: tuple[str, ...] = (), **names) -> None:
    """Put the days of df into the profile at path. A day that is there already is replaced, so a day can be added again; others are
    neither read nor written. The days must be whole: what df has of a day is the day."""
    made = partials(df, day, *by, **names)
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Rows of partials() as one for each of `by`, still mergeable; without `by` one for all."""
    sums = [F.sum(c).alias(c) for c in _SUMS]
    ranges = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in _RANGES for n, f in (("min", F.min), ("max", F.max))]
    sketches = [F.kll_merge_agg_bigint(f"{c}_sketch", F.lit(KLL_SIZE)).alias(f"{c}_sketch") for c in _RANGES]
    return parts.groupBy(*by).agg(*sums, *ranges, *sketches, F.hll_union_agg("texts_sketch").alias("texts_sketch"))


def described(parts: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Rows of partials() or merged() as a profile: shares in percent, means, quantiles, and about how many texts are distinct."""
    mean = lambda s, n: F.round(F.col(s) / F.nullif(F.col(n), F.lit(0)), 6)
    kept = [c for c in parts.columns if not c.endswith("_sketch") and c not in ("ai_words", "human_words")]
    share = lambda c: F.round(F.col(c) * 100.0 / F.col("rows"), 2)
    known = F.col("rows") - F.col("null_texts")
    at = lambda c, q: F.when(known > 0, F.kll_sketch_get_quantile_bigint(f"{c}_sketch", F.lit(q)))
    return parts.select(
        *kept, share("ai_rows").alias("ai_percent"), share("human_rows").alias("human_percent"),
        F.round(F.col("words") / F.nullif(known, F.lit(0)), 6).alias("mean_words"), F.round(F.col("chars") / F.nullif(known, F.lit(0)), 6).alias("mean_chars"),
        mean("ai_words", "ai_rows").alias("ai_mean_words"), mean("human_words", "human_rows").alias("human_mean_words"),
        *[at(c, q).alias(f"{c}_q{round(q * 100)}") for c in _RANGES for q in quantiles], F.hll_sketch_estimate("texts_sketch").alias("distinct_texts"),
    )


def profile(spark: SparkSession, path: str, *by: str, first: str | None = None, last: str | None = None, day: str = "day") -> DataFrame:
    """The profile kept at path, for each of `by` over the days from first to last; only their folders are read."""
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    parts = spark.read.parquet(path)
    if first is not None:
        parts = parts.where(F.col(day) >= F.lit(first))
    if last is not None:
        parts = parts.where(F.col(day) <= F.lit(last))
    return described(merged(parts, *by))
