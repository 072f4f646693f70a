"""Sources, sinks and streams over temporary files."""

import os

import pytest
from pyspark.sql import functions as F

from quern.sources import datasource, files, tables
from quern.streaming import events


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return str(path)


@pytest.mark.parametrize("d", [",", ";", "\t", "|"])
def test_delimited(spark, tmp_path, d):
    path = write(f"{tmp_path}/m.csv", f" Path {d}LABEL\na.png{d}1\nb.png{d}0\n", "utf-8-sig")
    df = tables.read_delimited(spark, path, ["path", "label"])
    assert df.columns == ["path", "label"] and df.count() == 2
    with pytest.raises(ValueError):
        tables.read_delimited(spark, path, ["split"])


def test_families_and_parts(spark, tmp_path):
    write(f"{tmp_path}/a/cleaned_1.csv", "text,y\nx,1\n")
    write(f"{tmp_path}/b/c/cleaned_2.csv", "y,text,more\n0,y,z\n")
    write(f"{tmp_path}/b/other.csv", "text\nno\n")
    got = {tuple(r) for r in datasource.read_family(spark, str(tmp_path)).select("text", "y", "more", "source_file").collect()}
    assert got == {("x", "1", None, "cleaned_1.csv"), ("y", "0", "z", "cleaned_2.csv")}
    assert tables.read_parts(spark, f"{tmp_path}/a", ["train.csv", "cleaned_1.csv"]).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_parts(spark, f"{tmp_path}/a", ["none.csv"])


def test_trees_and_listings(spark, tmp_path):
    write(f"{tmp_path}/t/human/a.txt", "hello")
    write(f"{tmp_path}/t/AI/x/b.txt", "robot")
    write(f"{tmp_path}/t/AI/empty.txt", " ")
    write(f"{tmp_path}/t/else/c.txt", "skip")
    assert {tuple(r) for r in files.text_tree(spark, f"{tmp_path}/t").collect()} == {("hello", "human"), ("robot", "ai")}
    for name in ("real/1.PNG", "fake/2.jpg", "fake/3.webp", "fake/notes.md", "_unsorted/4.png"):
        write(f"{tmp_path}/i/{name}", "x" * len(name))
    assert [tuple(r) for r in files.image_listing(spark, f"{tmp_path}/i").collect()] == [("2.jpg", "fake"), ("1.PNG", "real")]
    assert files.images(spark, f"{tmp_path}/i").count() == 3  # Spark itself hides what begins with _
    listing = files.list_files(spark, f"{tmp_path}/i")
    best = files.best_candidate(listing, ["png", "jpg"], ["2", "1"]).first()["path"]
    assert best.endswith("1.PNG")
    assert files.latest(listing, ".md").first()["path"].endswith("notes.md") and files.latest(listing, ".zip").count() == 0
    items = spark.createDataFrame([("i", "a.txt", 6000), ("i", "b_djvu.txt", 9000), ("i", "c.txt", 7000), ("j", "d.txt", 10)], "item string, name string, size long")
    assert [r["name"] for r in files.choose_item_file(items, "item").collect()] == ["c.txt"]
    assert spark.range(1).select(files.middle_text(F.lit("0123456789"), most=4)).first()[0] == "2345"


def test_jsonl_config_reports(spark, tmp_path):
    schema = "a long, b string"
    assert tables.read_jsonl(spark, f"{tmp_path}/none.jsonl", schema).count() == 0
    df = spark.createDataFrame([(1, "x")], schema)
    for _ in range(2):
        tables.append_jsonl(df, f"{tmp_path}/log")
    assert tables.read_jsonl(spark, f"{tmp_path}/log", schema).count() == 2
    path = write(f"{tmp_path}/c.json", '{"a": 1}')
    assert tables.read_config(spark, path, ["a"]) == {"a": 1}
    with pytest.raises(ValueError):
        tables.read_config(spark, path, ["b"])
    assert tables.report_markdown("T", df).splitlines()[2:] == ["| a | b |", "|---|---|", "| 1 | x |"] and tables.report_json(df) == '[{"a": 1, "b": "x"}]'


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "path string, label int")
    tables.write_manifest(df.where("false"), f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m", header=True).columns == list(tables.MANIFEST)
    p = f"{tmp_path}/t"
    df.write.parquet(p)
    tables.overwrite_in_place(spark.read.parquet(p).withColumn("label", F.col("label") + 1), p)
    assert spark.read.parquet(p).first()["label"] == 2 and spark.read.parquet(p + ".bak").first()["label"] == 1
    both = spark.createDataFrame([("t", 0, "m")], "text string, is_generated int, meta string")
    tables.write_dual(both, f"{tmp_path}/raw", f"{tmp_path}/clean")
    assert spark.read.parquet(f"{tmp_path}/clean").columns == ["text", "is_generated"]
    plan = tables.quarantine_plan(spark.createDataFrame([("/d/x/1.png", "bad")], "path string, reason string"), "/d", "/q").first()
    assert tuple(plan) == ("/d/x/1.png", "/q/x/1.png", "bad")
    nested = spark.createDataFrame([(1, [1, 2], {"k": "v"})], "a int, b array<int>, c map<string,string>")
    assert tuple(tables.jsonify(nested).first()) == (1, "[1,2]", '{"k":"v"}')


def test_feed(spark, tmp_path):
    write(f"{tmp_path}/f.xml", "<feed><entry><id>1</id><title>A\n b</title><summary>s t</summary><published>2013-05-01T00:00:00Z</published></entry><entry><id>2</id><title>C</title><summary>x</summary><published>2020-01-01</published></entry></feed>")
    assert [tuple(r)[:3] for r in tables.read_feed(spark, f"{tmp_path}/f.xml").collect()] == [("1", "A b", "s t")]


def test_manifests(spark):
    listing = spark.createDataFrame([("1.png", "real"), ("2.png", "odd")], "image_name string, category string")
    with pytest.raises(Exception, match="unknown category odd"):
        tables.assign_labels(listing, {"real": 0}).collect()
    got = tables.assign_labels(listing, {"real": 0}, allow_unknown=True).collect()
    assert [(r["label"], r["split"]) for r in got] == [(0, None), (-1, "skipped_unknown")]
    there = spark.createDataFrame([("/app/data/real/1.png",)], "path string")
    assert tables.eval_manifest(listing.where("category = 'real'"), {"real": 0}, "test", there=there).first()["path"] == "/app/data/real/1.png"
    with pytest.raises(Exception, match="not there: /app/data/odd/2.png"):
        tables.eval_manifest(listing, {"real": 0, "odd": 1}, "test", there=there).collect()


def test_streams_agree_with_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{tmp_path}/in"
    batch.repartition(3).write.parquet(folder)
    stream = events.read_events(spark, folder, batch.schema)
    q = events.without_repeats(stream, ["event_id"], late="100 days").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == events.without_repeats(batch, ["event_id"]).count()
    q = events.daily_counts(events.read_events(spark, folder, batch.schema), ["click"], late="100 days").writeStream.format("memory").queryName("days").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["day"]: r["n"] for r in spark.table("days").groupBy("day").agg(F.max("n").alias("n")).collect()}
    assert got == {r["day"]: r["n"] for r in events.daily_counts(batch, ["click"]).collect()}


def test_running_quota(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    folder = f"{tmp_path}/q"
    batch.write.parquet(folder)
    stream = events.read_events(spark, folder, batch.schema, files_per_batch=100)
    q = events.running_quota(stream, "user_id", 2).writeStream.format("memory").queryName("quota").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("quota").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.count_if("allowed").alias("a")).collect()
    assert sum(r["n"] for r in got) == batch.count() and all(r["a"] == min(2, r["n"]) for r in got)


def test_running_quota_out_of_order(spark, tmp_path):
    """Events of several days in shuffled files, late ones among them: the same counts as over the whole table."""
    import random

    draw = random.Random(4)
    rows = [(draw.randrange(4), f"2024-01-0{draw.randrange(1, 5)} {draw.randrange(24):02d}:{draw.randrange(60):02d}:00") for _ in range(160)]
    folder = f"{tmp_path}/shuffled"
    for k in range(8):
        spark.createDataFrame(rows[k::8], "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    stream = events.read_events(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    q = events.running_quota(stream, "user_id", 2, late="10 days").writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.table("late").collect():
        assert r["allowed"] == (r["n"] <= 2)
        got.setdefault((r["user_id"], r["ts"].date()), []).append(r["n"])
    want = {}
    for user, t in rows:
        want[user, t[:10]] = want.get((user, t[:10]), 0) + 1
    assert {(u, str(d)): sorted(n) for (u, d), n in got.items()} == {k: list(range(1, n + 1)) for k, n in want.items()}


def test_quota_state_shrinks(spark, tmp_path):
    """Days behind the watermark leave the state, and late events that it still lets in count on their own day."""
    folder, n = f"{tmp_path}/in", 40
    batches = [[(u, f"2024-01-0{d} 10:00:00") for u in range(n) for d in (1, 2)], [(0, "2024-01-01 09:00:00"), (1, "2024-01-03 09:00:00")], [(5, "2024-02-20 00:00:00")], [(5, "2024-02-20 01:00:00"), (6, "2024-01-02 00:00:00")]]
    schema = "user_id long, ts timestamp"

    def feed(rows):
        spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        stream = events.read_events(spark, folder, schema)
        q = events.running_quota(stream, "user_id", 1, late="2 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    sizes = [feed(b) for b in batches]
    assert sizes[0] >= 2 * n and sizes[-1] < n / 4, sizes
    got = {(r["user_id"], str(r["ts"]), r["n"], r["allowed"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert (0, "2024-01-01 09:00:00", 2, False) in got and (1, "2024-01-03 09:00:00", 1, True) in got and (5, "2024-02-20 01:00:00", 2, False) in got
    assert len(got) == 2 * n + 4  # user 6's event came behind the watermark
