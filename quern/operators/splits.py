"""Splits, folds, holdouts, resampling and weights.

The shuffle is a hash of seed and key, so it is deterministic and the same in any SQL engine. Sizes are exact. Ranks inside a
class come from a window by class; ranks over the whole table are counted over slices of the hash first, so that no task
sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.names import fresh

#: Hex digits of the hash that name a slice: 65,536 slices.
DIGITS = 4
#: Rows that a split leaves as they are: their label is unknown.
SKIPPED = "skipped_unknown"
#: Copies that one row of the first level stands for when strata are balanced.
COPIES = 4096


def shuffle_key(key: str, seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)


def ranked(df: DataFrame, key: str, seed: int, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Add the 1-based rank in shuffled order, over all rows or inside `by`. Rows are dealt by the first hex digits of
    their hash; slices are counted (65,536 rows a class at most), and a row's rank is its slice's offset plus its place there."""
    by = by or []
    h, s, n, ahead, p = fresh(df, "h", "s", "n", "before", "p")
    dealt = df.withColumn(h, shuffle_key(key, seed)).withColumn(s, F.substring(h, 1, DIGITS))
    before = dealt.groupBy(*by, s).agg(F.count("*").alias(n))
    offsets = Window.partitionBy(*by).orderBy(s).rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(0)).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn(ahead, F.coalesce(F.sum(n).over(offsets), F.lit(0))).drop(n)
    place = F.row_number().over(Window.partitionBy(*by, s).orderBy(h, key))
    on = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in [*by, s]]
    joined = dealt.withColumn(p, place).alias("l").join(before.alias("r"), on)
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col(p) + F.col(ahead)).alias(out))


def stratified_split(df: DataFrame, label: str, key: str, fraction: float, seed: int = 42, classes: int | None = 2, out: str = "part") -> DataFrame:
    """test for the first round-half-even(n * fraction) of each class, else train. Reading it is an error unless there are `classes` classes."""
    n, k, t, y = fresh(df, "n", "k", "t", "y")
    counts = df.groupBy(F.col(label).alias(y)).agg(F.count("*").alias(n))
    sized = counts.select(y, F.bround(F.col(n) * F.lit(fraction), 0).alias(t))
    r = ranked(df, key, seed, [label], k)
    made = r.join(sized, r[label].eqNullSafe(sized[y])).withColumn(out, F.when(F.col(k) <= F.col(t), "test").otherwise("train")).drop(k, t, y)
    return made if classes is None else checks.fact(made, counts.agg(F.count("*").alias(n)), F.col(n) != classes, f"{classes} classes are needed, got ", F.col(n))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Folds 0 .. k-1 in runs of the shuffled class; the first n mod k folds have one row more."""
    n, rank, y = fresh(df, "n", "k", "y")
    counts = df.groupBy(F.col(label).alias(y)).agg(F.count("*").alias(n))
    r = ranked(df, key, seed, [label], rank)
    q, more, at = F.floor(F.col(n) / k), F.col(n) % k, F.col(rank) - 1
    fold = F.when(at < more * (q + 1), F.floor(at / (q + 1))).otherwise(more + F.floor((at - more * (q + 1)) / F.greatest(q, F.lit(1))))
    return r.join(counts, r[label].eqNullSafe(counts[y])).withColumn(out, fold.cast("int")).drop(rank, n, y)


def eligible(df: DataFrame, out: str) -> Column:
    """Rows that a split decides on: all but those that already say SKIPPED."""
    return F.coalesce(F.col(out) != SKIPPED, F.lit(True)) if out in df.columns else F.lit(True)


def group_split(df: DataFrame, group: str, fraction: float, seed: int = 42, out: str = "split", key: str | None = None) -> DataFrame:
    """Whole groups go to val, in shuffled order, until it has max(1, int(n * fraction)) rows, one group at least; rows without a
    group (null or empty) go to train. n counts eligible rows; rows that say SKIPPED keep that. Without any group it is
    the row split by `key`. Only group sizes are put in order."""
    g, n, h, s, m, before, i, v, k = fresh(df, "g", "n", "h", "s", "m", "before", "i", "v", "k")
    takes, named = eligible(df, out), F.when(F.col(group) != "", F.col(group))
    sizes = df.where(takes).groupBy(named.alias(g)).agg(F.count("*").alias(n))
    total, groups = sizes.agg(F.sum(n), F.count(g)).first()
    if not groups:
        if key is None:
            raise ValueError("there are no groups: the row split needs a key")
        return row_split(df, key, fraction, seed, out)
    target = max(1, int(total * fraction))
    r = sizes.where(F.col(g).isNotNull()).withColumn(h, shuffle_key(g, seed)).withColumn(s, F.substring(h, 1, DIGITS))
    offsets = r.groupBy(s).agg(F.sum(n).alias(m)).withColumn(
        before, F.coalesce(F.sum(m).over(Window.partitionBy(F.lit(0)).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(s).orderBy(h, g).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    val = r.withColumn(i, inside).join(offsets.drop(m), s).where(F.col(before) + F.col(i) < target).select(g, F.lit("val").alias(v))
    said = F.when(takes, F.coalesce(v, F.lit("train"))).otherwise(F.lit(SKIPPED))
    return df.withColumn(k, named).join(val, F.col(k) == F.col(g), "left").withColumn(out, said).drop(k, g, v)


def row_split(df: DataFrame, key: str, fraction: float, seed: int = 42, out: str = "split") -> DataFrame:
    """val for the first max(1, int(n * fraction)) shuffled rows (all of fewer than two), else train. n counts eligible rows; rows
    that say SKIPPED keep that and are not ranked."""
    (k,) = fresh(df, "k")
    takes = eligible(df, out)
    n = df.where(takes).count()
    size = max(1, int(n * fraction)) if n > 1 else n
    made = ranked(df.where(takes), key, seed, None, k).withColumn(out, F.when(F.col(k) <= size, "val").otherwise("train")).drop(k)
    return made.unionByName(df.where(~takes)) if out in df.columns else made


GROUP_COLUMNS = ("group_id", "subject_id", "source_id", "generator_id")


def derive_groups(df: DataFrame, name: str, out: str = "group") -> DataFrame:
    """Add a group: the first of GROUP_COLUMNS that has a value, else the name without its extension up to the first _, - or blank
    (all of it, where there is none), if parts that occur again cover half the rows; parts that occur once are no group."""
    p, many, q = fresh(df, "p", "n", "q")
    there = [c for c in GROUP_COLUMNS if c in df.columns]
    if there:
        has = df.agg(*[F.count(c).alias(c) for c in there]).first()
        for c in there:
            if has[c]:
                return df.withColumn(out, F.nullif(F.col(c).cast("string"), F.lit("")))
    stem = F.regexp_replace(F.col(name).cast("string"), r"(?s)\.[^.]*$", "")
    df = df.withColumn(p, F.regexp_extract(stem, r"(?s)^([^_\- ]*)", 1))
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias(many)).where(F.col(many) > 1)
    joined = df.join(counts.withColumnRenamed(p, q), F.col(p) == F.col(q), "left")
    n, covered = joined.agg(F.count("*"), F.count(many)).first()
    group = F.nullif(F.col(q), F.lit("")) if n and covered * 2 >= n else F.lit(None).cast("string")
    return joined.withColumn(out, group).drop(p, q, many)


def load_or_create(spark, path: str, make, regenerate: bool = False) -> DataFrame:
    """A frozen manifest: read it if it is there, else make it and write it once."""
    from ..sources.files import exists

    if regenerate or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def holdouts(df: DataFrame, column: str, split: str = "split") -> DataFrame:
    """The manifest once per value of a column: rows in train or val are val where they have the value and train elsewhere; other
    splits stay. Null counts as the empty value, which is no holdout. The values are few: their table is the small side."""
    value = F.coalesce(F.col(column), F.lit(""))
    values = df.select(value.alias("holdout")).where("holdout <> ''").distinct()
    moved = F.when(F.col(split).isin("train", "val"), F.when(value == F.col("holdout"), "val").otherwise("train")).otherwise(F.col(split))
    return df.crossJoin(values).withColumn(split, moved)


def holdout_summary(made: DataFrame, split: str = "split") -> DataFrame:
    return made.groupBy("holdout").agg(F.count_if(F.col(split) == "train").alias("train_rows"), F.count_if(F.col(split) == "val").alias("val_rows"))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(shuffle_key(key, seed), key)


def balance(df: DataFrame, by: list[str], key: str, seed: int = 42) -> DataFrame:
    """Upsample each stratum to the largest: row k of n comes once for every place k, k + n, ... up to the largest size. Adds copy_no."""
    n, m, k, c, u, l = fresh(df, "n", "m", "k", "c", "u", "l")
    sizes = df.groupBy(*by).agg(F.count("*").alias(n))
    sizes = sizes.crossJoin(sizes.agg(F.max(n).alias(m)))
    r = ranked(df, key, seed, by, k)
    joined = r.alias("r").join(sizes.alias("s"), [F.col(f"r.`{x}`").eqNullSafe(F.col(f"s.`{x}`")) for x in by])
    # two levels, as one row of a small stratum may stand for most of the result
    most = F.floor((F.col(m) - F.col(k)) / F.col(n))
    given = [f"`{x}`" for x in df.columns]
    high = joined.select(*[F.col(f"r.{x}") for x in given], most.alias(c), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(most / COPIES))).alias(u))
    low = F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES - 1).cast("long"), F.col(c) - F.col(u) * COPIES))
    return high.select(*given, u, F.explode(low).alias(l)).select(*given, (F.col(u) * COPIES + F.col(l)).alias("copy_no"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight total / (classes * n)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__t"), F.count("*").alias("__c"))
    return counts.crossJoin(total).select(label, "n", (F.col("__t") / (F.col("__c") * F.col("n"))).alias("weight"))


def assign_prompts(df: DataFrame, key: str, prompts: list[str], seed: int = 42) -> DataFrame:
    """Add prompt_used and a temperature from 0.3 to 0.9 with two decimals, both from the key's hash."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    part = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("long")
    at = (part(1) % len(prompts)).cast("int") + 1
    return df.withColumns({"prompt_used": F.element_at(F.array(*map(F.lit, prompts)), at), "temperature": F.round(0.3 + part(9) % 61 / 100, 2)})


def tuning_split(available: list[str], preferences: list[str], eval_split: str) -> str:
    """The first preference that is there; else the eval split, unless it is a preference itself."""
    for p in preferences:
        if p in available:
            return p
    if eval_split in available and eval_split not in preferences:
        return eval_split
    raise ValueError(f"none of {preferences} in {available}")


def head(df: DataFrame, order: str, n: int = 50) -> DataFrame:
    return df.orderBy(order).limit(n)
