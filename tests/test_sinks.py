"""Logs and baselines under replays and several writers."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from quern.operators import governance
from quern.sources import files
from quern.streaming import sinks

SCHEMA = "id long, at string, note string"


def ids(spark, path):
    return sorted((r["id"] for r in sinks.read_log(spark, path, SCHEMA).collect()), key=str)


def test_append_once(spark, tmp_path):
    path = f"{tmp_path}/log"
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert ids(spark, path) == []
    one = df([(1, "2024-01-01 10:00:00", "a"), (2, "2024-01-02 10:00:00", None), (None, None, "x"), (2, "2024-01-02 10:00:00", "twice")])
    for _ in range(3):
        sinks.append_once(one, 0, path, ["id"], "w", "at")
        assert ids(spark, path) == [1, 2, None]
    sinks.append_once(df([(2, "2024-01-02 10:00:00", "again"), (None, None, "y"), (3, "2024-01-02 11:00:00", "c")]), 1, path, ["id"], "w", "at")
    sinks.append_once(df([(3, "2024-01-02 11:00:00", "other writer"), (4, "2024-01-03 00:00:00", "d")]), 1, path, ["id"], "v", "at")
    sinks.append_once(one.where("false"), 2, path, ["id"], "w", "at")
    assert ids(spark, path) == [1, 2, 3, 4, None]
    got = {r["id"]: (r["writer"], r["batch"], str(r["day"])) for r in sinks.read_log(spark, path, SCHEMA).collect()}
    assert got[3] == ("w", 1, "2024-01-02") and got[4] == ("v", 1, "2024-01-03")
    with pytest.raises(ValueError, match="day"):
        sinks.append_once(one.withColumn("day", F.lit(1)), 3, path, ["id"], "w", "at")


def test_only_the_batches_days_are_read(spark, tmp_path):
    path = f"{tmp_path}/log"
    for k in range(1, 4):
        sinks.append_once(spark.createDataFrame([(k, f"2024-01-0{k} 10:00:00", "n")], SCHEMA), k, path, ["id"], "w", "at")
    plan = sinks.read_log(spark, path, SCHEMA).where("day between date'2024-01-02' and date'2024-01-02'")
    assert "PartitionFilters: [isnotnull(day" in plan._jdf.queryExecution().toString() and plan.count() == 1


REQUESTS = "timestamp string, user_id string, manifest_path string, label_mapping_hash string, split_frozen boolean, eval_split string, tuning_split string, forbid_test_tuning boolean, drift boolean, heldout_today int, override boolean, model_hash string"
CONFIG = governance.Config(held_out_splits=["test"], max_heldout_evals_per_day=2, selection_metric="f1")


def request(k, good=True, override=False):
    return (f"2024-03-01 10:00:{k:02d}", f"u{k}", "m.csv" if good else None, "h", True, "val", "train", True, False, 0, override, f"model{k}")


def test_stream_with_replayed_batch(spark, tmp_path):
    """The batch that a stream had begun when it was stopped comes again: log and baseline stay as they are."""
    folder, log, base = f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/baseline.json"
    spark.createDataFrame([request(1, good=False), request(2, override=True), request(3), request(4)], REQUESTS).coalesce(1).write.parquet(folder)
    sink, seen = sinks.governed(CONFIG, log, base, "w"), []

    def failing(batch, batch_id):
        sink(batch, batch_id)
        seen.append(batch_id)
        if len(seen) == 1:
            raise RuntimeError("lost before the offset is committed")

    def run():
        stream = spark.readStream.schema(REQUESTS).parquet(folder)
        stream.writeStream.foreachBatch(failing).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)

    with pytest.raises(Exception, match="lost"):
        run()
    pinned = files.read_head(spark, base)
    assert json.loads(pinned)["model_hash"] == "model3"
    run()
    assert seen == [0, 0] and files.read_head(spark, base) == pinned
    got = sinks.read_log(spark, log, "timestamp string, user_id string, allowed boolean, valid boolean, reason string").orderBy("user_id").collect()
    assert [(r["user_id"], r["allowed"], r["valid"]) for r in got] == [("u1", False, False), ("u2", True, False), ("u3", True, True), ("u4", True, True)]
    spark.createDataFrame([request(0)], REQUESTS).coalesce(1).write.mode("append").parquet(folder)  # earlier, but too late to be the first
    run()
    assert files.read_head(spark, base) == pinned and sinks.read_log(spark, log, "user_id string").count() == 5


def test_one_of_many_writers_pins(spark, tmp_path):
    path, won = f"file://{tmp_path}/baseline.json", []
    gate = threading.Barrier(6)

    def claim(k):
        gate.wait()
        if sinks.pin_once(spark, path, f"writer {k}"):
            won.append(k)

    threads = [threading.Thread(target=claim, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and files.read_head(spark, path) == f"writer {won[0]}"
    assert not sinks.pin_once(spark, path, "later") and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["baseline.json"]
