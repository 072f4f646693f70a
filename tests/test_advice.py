"""Cases from reviews: what a query once did less of than the whole job."""

import random

import duckdb

from quern.plans import registry


def test_summary_counts_near_pairs(spark, tmp_path):
    draw = random.Random(3)
    rows = [(k, [draw.choice([-1.0, 1.0]) for _ in range(64)]) for k in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["dup_summary"](spark, str(tmp_path)).first()
    assert got["files"] == 43 and got["exact_pairs"] == 3
    assert got["near_pairs"] >= 20
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.sql(registry.ORACLE["dup_summary"])
    assert [tuple(got[c] for c in want.columns)] == want.fetchall()
