"""Profiles from daily sketches: exact counts, quantiles and distinct counts within their bounds, days added without the others."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from quern.operators import profile, sketches


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    """Thirty days of 1,000 texts of very unequal lengths, in a folder a day."""
    draw, root = random.Random(2), str(tmp_path_factory.mktemp("days")) + "/d"
    rows = []
    for d in range(1, 32):
        for k in range(1000):
            n = int(draw.paretovariate(1.1) * 5) if d % 3 else draw.randrange(50, 60)
            text = None if draw.random() < 0.01 else " ".join(f"w{draw.randrange(10)}" for _ in range(min(n, 900))) + (f" {k}" if draw.random() < 0.7 else "")
            rows.append((f"2024-01-{d:02d}", text, draw.choice([0, 1, 1, None, 7]), f"s{k % 3}"))
    spark.createDataFrame(rows, "day string, text string, is_generated int, source string").write.partitionBy("day").parquet(root)
    return root


def within(values, estimate, q, error):
    values = sorted(values)
    below = sum(v < estimate for v in values) / len(values)
    upto = sum(v <= estimate for v in values) / len(values)
    return below - error <= q <= upto + error


def test_thirty_days_equal_the_whole(spark, days, tmp_path):
    path = f"{tmp_path}/profile"
    whole = spark.read.parquet(days).where("day <= '2024-01-30'")
    for k in range(0, 30, 10):  # three writes of ten days each
        part = whole.where(F.col("day").between(f"2024-01-{k + 1:02d}", f"2024-01-{k + 10:02d}"))
        sketches.add_days(part, path, by=("source",))
    got = sketches.profile(spark, path).first()
    want = profile.corpus_profile(whole).first()
    for c in ("rows", "ai_rows", "human_rows", "other_rows", "null_texts", "null_labels", "ai_percent", "human_percent", "min_words", "max_words", "min_chars", "max_chars", "mean_words", "mean_chars"):
        assert got[c] == want[c], c
    data = whole.selectExpr("size(regexp_extract_all(text, '\\\\S+', 0)) as w", "length(text) as c").where("text is not null").toPandas()
    for q in (25, 50, 75):
        assert within(data["w"], got[f"words_q{q}"], q / 100, sketches.RANK_ERROR) and within(data["c"], got[f"chars_q{q}"], q / 100, sketches.RANK_ERROR), q
    exact = whole.select("text").distinct().count()
    assert abs(got["distinct_texts"] - exact) <= 3 * sketches.DISTINCT_ERROR * exact
    per = {r["source"]: r for r in sketches.profile(spark, path, "source").collect()}
    assert {s: r["rows"] for s, r in per.items()} == {r["source"]: r["count"] for r in whole.groupBy("source").count().collect()}


def test_a_day_is_added_without_the_others(spark, days, tmp_path):
    path, copy = f"{tmp_path}/profile", f"{tmp_path}/copy"
    shutil.copytree(days, copy)
    sketches.add_days(spark.read.parquet(copy).where("day <= '2024-01-05'"), path)
    before = sketches.profile(spark, path).first()
    for d in range(1, 31):
        shutil.rmtree(f"{copy}/day=2024-01-{d:02d}")  # what is profiled is not needed again
    last = spark.read.parquet(f"{copy}/day=2024-01-31").withColumn("day", F.lit("2024-01-31"))
    for _ in range(2):  # a day added twice counts once
        sketches.add_days(last, path)
        got = sketches.profile(spark, path).first()
        assert got["rows"] == before["rows"] + 1000 and got["words"] == before["words"] + last.selectExpr("sum(size(regexp_extract_all(text, '\\\\S+', 0)))").first()[0]
    some = sketches.profile(spark, path, first="2024-01-02", last="2024-01-03")
    assert some.first()["rows"] == 2000 and "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().toString()
    with pytest.raises(FileNotFoundError):
        sketches.profile(spark, f"{tmp_path}/none")


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, None, "a"), ("", 0, "b"), ("x y", 1, "b")], "text string, is_generated int, k string")
    got = {r["k"]: r for r in sketches.described(sketches.partials(df, "k")).collect()}
    assert got["a"]["words_q50"] is None and got["a"]["mean_words"] is None and got["a"]["null_texts"] == 1
    assert (got["b"]["min_words"], got["b"]["max_words"], got["b"]["ai_mean_words"], got["b"]["human_mean_words"]) == (0, 2, 2.0, 0.0)
    assert sketches.described(sketches.merged(sketches.partials(df.where("false"), "k"), "k")).count() == 0
