"""Unions, duplicates, overlaps, duplicate-pair audits and the repair of leakage between splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.names import fresh


def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a side lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows that agree in the keys the first by `order`. Null keys are a group of their own. Groups meet by a digest of their
    keys, and each task sends one row of a group, so a text that most rows have is no load for one task."""
    parts = [F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(F.col(order).isNotNull(), F.col(order)))
    return df.groupBy(F.sha2(F.concat(*parts), 256).alias("__k")).agg(first.alias("__r")).select("__r.*")


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """(rows, distinct_keys, duplicates) over whole keys, nulls included."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )


def shared_texts(left: DataFrame, right: DataFrame, text: str = "text") -> DataFrame:
    """Stripped texts that both sides have."""
    one = lambda d: d.select(F.trim(F.col(text)).alias(text))
    return one(left).intersect(one(right))


def overlap_count(train: DataFrame, test: DataFrame, text: str = "text") -> DataFrame:
    """(overlap): distinct texts in both; what is shuffled are hashes."""
    one = lambda d: d.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("h"))
    return one(train).intersect(one(test)).agg(F.count("*").alias("overlap"))


SIDES = ("split", "label", "dataset_id", "domain")


def _sides(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select("hash", F.col("path").alias(f"{prefix}_path"), *[F.col(c).alias(f"{prefix}_{c}") for c in (*SIDES, *more) if c in df.columns])


def with_hash(df: DataFrame, content: str) -> DataFrame:
    return df.withColumn("hash", F.sha2(F.col(content), 256))


def exact_pairs(df: DataFrame) -> DataFrame:
    """All pairs of files with one hash (path, hash and any of split, label, dataset_id, domain), the lesser path left, with
    cross_split; a path listed several times pairs with itself. The report lists every pair; `exact_groups` is the form without."""
    rest = [F.col(c) for c in SIDES if c in df.columns]
    numbered = df.withColumn("no", F.row_number().over(Window.partitionBy("hash", "path").orderBy(*rest or [F.lit(0)])))
    a, b = _sides(numbered, "a", "no"), _sides(numbered, "b", "no")
    out = a.join(b, "hash").where("a_path < b_path or (a_path = b_path and a_no < b_no)").drop("a_no", "b_no")
    return out.withColumn("cross_split", F.col("a_split") != F.col("b_split")) if "split" in df.columns else out


def exact_groups(df: DataFrame) -> DataFrame:
    """(path, hash, group_size, splits): members of each group of equal hashes, one row a member."""
    groups = df.groupBy("hash").agg(F.count("*").alias("group_size"), F.array_sort(F.collect_set("split")).alias("splits")).where("group_size > 1")
    return df.select("path", "hash").join(groups, "hash")


def average_hash_bits(values, out: str = "ahash_bits"):
    """64 characters 0 or 1 of an array of 64 values: above the mean or equal to it."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.array_join(F.transform(values, lambda x: F.when(x >= mean, "1").otherwise("0")), "").alias(out)


def bits_to_long(bits):
    """The 64 bits as a signed long; a negative base makes conv() write it signed."""
    return F.conv(bits, 2, -10).cast("long")


def near_pairs(df: DataFrame, hash_: str = "ahash", most: int = 5, prefix_bits: int = 16, key: str = "path") -> DataFrame:
    """Pairs whose hashes share the first prefix_bits and differ in `most` bits at most. The prefix is the join's key, so the
    join shuffles; what two hashes share elsewhere is not found. Rows of one hash pair too, at distance 0."""
    side = lambda p: df.select(F.col(key).alias(f"{p}_{key}"), F.col(hash_).alias(f"{p}_hash"), F.shiftrightunsigned(F.col(hash_), 64 - prefix_bits).alias("prefix"), *[F.col(c).alias(f"{p}_{c}") for c in SIDES if c in df.columns])
    out = side("a").join(side("b"), "prefix").where(F.col(f"a_{key}") < F.col(f"b_{key}"))
    out = out.withColumn("distance", F.bit_count(F.col("a_hash").bitwiseXOR(F.col("b_hash")))).where(F.col("distance") <= most)
    return out.withColumn("cross_split", F.col("a_split") != F.col("b_split")) if "split" in df.columns else out


def near_pairs_banded(df: DataFrame, hash_: str = "ahash", most: int = 5, key: str = "path") -> DataFrame:
    """The same without loss: hashes within `most` bits agree in one of most + 1 bands. One row a pair."""
    bands = most + 1
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(F.shiftleft(F.col(hash_), a), 64 - (b - a)).alias("bits")) for k, (a, b) in enumerate(zip(edges, edges[1:]))])
    side = lambda p: df.select(F.col(key).alias(f"{p}_{key}"), F.col(hash_).alias(f"{p}_hash"), F.explode(keys).alias("band"))
    out = side("a").join(side("b"), "band").where(F.col(f"a_{key}") < F.col(f"b_{key}"))
    return out.withColumn("distance", F.bit_count(F.col("a_hash").bitwiseXOR(F.col("b_hash")))).where(F.col("distance") <= most).drop("band").distinct()


def audit_summary(files: DataFrame, exact: DataFrame, near: DataFrame) -> DataFrame:
    """One row of counts: files, errors (null hash), pairs of both kinds and how many cross splits."""
    count = lambda d, p: d.agg(F.count("*").alias(f"{p}_pairs"), F.count_if("cross_split").alias(f"{p}_cross_split"))
    return files.agg(F.count("*").alias("files"), F.count_if(F.col("hash").isNull()).alias("errors")).crossJoin(count(exact, "exact")).crossJoin(count(near, "near"))


def repair_leakage(manifest: DataFrame, hashes: DataFrame) -> DataFrame:
    """manifest (path, split, ...) with every group of equal files in one split: train if the group has at least as many train
    rows as val rows, else val. Only groups of several rows over several splits change. hashes: (path, hash)."""
    rows = manifest.join(hashes.select("path", "hash").distinct(), "path", "left")
    target = (
        rows.where(F.col("hash").isNotNull()).groupBy("hash")
        .agg(F.count("*").alias("n"), F.count_distinct("split").alias("k"), F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "val").alias("v"))
        .where("n > 1 and k > 1").select("hash", F.when(F.col("t") >= F.col("v"), "train").otherwise("val").alias("target"))
    )
    return rows.join(target, "hash", "left").withColumn("split", F.coalesce("target", "split")).select(*manifest.columns)


def lookup(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join on a dictionary table; Catalyst broadcasts it when its size allows."""
    return df.join(dimension, key, "left")


def with_frequency(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Each row with its key's count. Counts are joined back, so a hot key is counted map-side."""
    (other,) = fresh(df, "key")
    counts = df.groupBy(key).agg(F.count("*").alias(out)).withColumnRenamed(key, other)
    return df.join(counts, df[key].eqNullSafe(counts[other]), "left").drop(other)


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def grid(*axes: DataFrame) -> DataFrame:
    """Every combination of small axes."""
    return reduce(lambda a, b: a.crossJoin(b), axes)


def zip_by_key(left: DataFrame, right: DataFrame, key: str, label: str = "y") -> DataFrame:
    """Join of two members' predictions; reading it is an error where a key is missing on a side or labels differ."""
    of_left, of_right, other = fresh(left.join(right.drop(label), key), "left", "right", "label")
    j = left.withColumn(of_left, F.lit(True)).join(right.withColumnRenamed(label, other).withColumn(of_right, F.lit(True)), key, "full_outer")
    j = checks.no_row(j, F.col(of_left).isNull() | F.col(of_right).isNull(), "members disagree: on one side only is ", F.col(key))
    return checks.no_row(j, ~F.col(label).eqNullSafe(F.col(other)), "members disagree in the label of ", F.col(key)).drop(of_left, of_right, other)
