"""Duplicates, splits, evaluation, governance, grids, tokens."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import chunk, dedup, evaluation as E, filters, governance as G, grid, profile, splits, tokens
from quern.sources import tables


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id long, text string")
    assert sorted(r["id"] for r in dedup.dedup_first(df, ["text"], "id").collect()) == [1, 3, 5]
    assert tuple(dedup.duplicate_count(df, ["text"]).first()) == (5, 3, 2)
    assert {r["text"] for r in dedup.shared_texts(df, spark.createDataFrame([(" a ",)], "text string")).collect()} == {"a"}
    assert {r["n"] for r in dedup.with_frequency(df, "text").where("text is null").collect()} == {2}


def test_leakage(spark):
    rows = [("p1", "train"), ("p2", "val"), ("p3", "val"), ("p4", "test"), ("p5", "val"), ("p6", "val")]
    hashes = [("p1", "h1"), ("p2", "h1"), ("p3", "h2"), ("p4", "h2"), ("p5", "h3"), ("p6", "h3")]
    m, h = spark.createDataFrame(rows, "path string, split string"), spark.createDataFrame(hashes, "path string, hash string")
    got = dict(map(tuple, dedup.repair_leakage(m, h).collect()))
    assert got == {"p1": "train", "p2": "train", "p3": "val", "p4": "val", "p5": "val", "p6": "val"}
    j = m.join(h, "path")
    twice = j.unionByName(j.where("path = 'p1'")).unionByName(j.where("path = 'p5'").withColumn("split", F.lit("test")))
    assert Counter((r["a_path"], r["b_path"], r["cross_split"]) for r in dedup.exact_pairs(twice).collect()) == Counter(
        {("p1", "p1", False): 1, ("p1", "p2", True): 2, ("p3", "p4", True): 1, ("p5", "p5", True): 1, ("p5", "p6", False): 1, ("p5", "p6", True): 1})
    assert dedup.exact_pairs(j).where("cross_split").count() == 2 and dedup.exact_groups(j).count() == 6


def test_near_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(f"p{k:03d}", v) for k, v in enumerate(signed)], "path string, ahash long")
    want = {(f"p{i:03d}", f"p{j:03d}") for i in range(80) for j in range(i + 1, 80) if (values[i] ^ values[j]).bit_count() <= 5}
    assert {(r["a_path"], r["b_path"]) for r in dedup.near_pairs_banded(df).collect()} == want
    blocked = {(r["a_path"], r["b_path"]) for r in dedup.near_pairs(df).collect()}
    assert blocked == {(a, b) for a, b in want if values[int(a[1:])] >> 48 == values[int(b[1:])] >> 48}


def test_member_checks(spark):
    a = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.9)], "sample_id long, y int, p double")
    for made, message in (
        (dedup.zip_by_key(a, a.where("sample_id = 1"), "sample_id"), "on one side only is 2"), (dedup.zip_by_key(a.where("sample_id = 2"), a, "sample_id"), "on one side only is 1"),
        (dedup.zip_by_key(a, a.withColumn("y", F.lit(1)), "sample_id"), "the label of 1"), (E.soft_vote(a.unionByName(a.withColumn("y", 1 - F.col("y")))), "the label of"),
        (E.soft_vote(a.unionByName(a.where("sample_id = 1"))), "in samples"),
    ):
        with pytest.raises(Exception, match=message):
            made.collect()
    assert dedup.zip_by_key(a, a.withColumnRenamed("p", "q"), "sample_id").count() == 2 and E.soft_vote(a.unionByName(a)).count() == 2


def test_checks_are_part_of_the_plan(spark, people):
    """No job runs while these plans are built."""
    a = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.9)], "sample_id long, y int, p double")
    listing = spark.createDataFrame([("1.png", "real"), ("2.png", "odd")], "image_name string, category string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "no job")
    made = [
        dedup.zip_by_key(a, a, "sample_id"), E.soft_vote(a), splits.stratified_split(people, "y", "id", 0.2), filters.split_frame(people.selectExpr("'val' as split", "1 as label"), "val"),
        tables.assign_labels(listing, {"real": 0, "odd": 1}), tables.eval_manifest(listing, {"real": 0, "odd": 1}, "test", there=spark.createDataFrame([("/app/data/real/1.png",), ("/app/data/odd/2.png",)], "path string")),
    ]
    assert len(tracker.getJobIdsForGroup("planning")) == 0
    spark.sparkContext.setJobGroup("after", "")
    assert [m.count() for m in made] == [2, 2, 103, 103, 2, 2]


def test_names_that_clash(spark):
    """Temporary names never take a column of the caller's, whatever the case of its letters."""
    names = ["__" + x for x in ("h", "s", "n", "k", "p", "g", "m", "before", "i", "v", "q", "t", "y", "c", "u", "l", "key", "decided", "ok", "words", "part", "PRED")]
    df = spark.createDataFrame([(k, k % 2, f"g{k % 3}", "w " * 120, "val", *range(len(names))) for k in range(20)], "id long, label int, grp string, text string, split string, " + ", ".join(f"`{n}` int" for n in names))
    for made in (
        splits.ranked(df, "id", 1), splits.ranked(df, "__h", 1), splits.stratified_split(df, "label", "id", 0.3), splits.stratified_folds(df, "label", "id", 3), splits.group_split(df, "grp", 0.3), splits.row_split(df, "id", 0.3),
        splits.balance(df, ["label"], "id"), splits.derive_groups(df.drop("grp"), "text"), dedup.with_frequency(df, "label"), filters.split_frame(df, "val"), chunk.fixed_chunks(df, size=50, least=10), chunk.at_most(df, "label", 5, "id"),
    ):
        assert made.count() > 0 and all([r[n] for n in names] == list(range(len(names))) for r in made.collect())


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(k, k % 2, f"g{k % 9}" if k % 4 else None, "en" if k % 3 else "de") for k in range(103)], "id long, y int, grp string, lang string")


def test_splits(people):
    parts = splits.stratified_split(people, "y", "id", 0.2).groupBy("y", "part").count().collect()
    assert {(r["y"], r["part"]): r["count"] for r in parts} == {(0, "test"): 10, (0, "train"): 42, (1, "test"): 10, (1, "train"): 41}
    folds = splits.stratified_folds(people, "y", "id", 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in sorted(folds, key=lambda r: r["fold"]) if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    with pytest.raises(Exception, match="2 classes are needed, got 1"):
        splits.stratified_split(people.where("y = 1"), "y", "id", 0.2).collect()
    ranks = [r["rank"] for r in splits.ranked(people, "id", 7).collect()]
    assert sorted(ranks) == list(range(1, 104))
    assert splits.row_split(people, "id", 0.1).where("split = 'val'").count() == 10


def test_group_split(people):
    got = splits.group_split(people, "grp", 0.2)
    assert got.groupBy("grp").agg(F.count_distinct("split").alias("n")).where("grp is not null and n > 1").count() == 0
    assert got.where("grp is null and split = 'val'").count() == 0
    assert got.where("split = 'val'").count() >= 20 and got.count() == 103
    # rows of unknown label are not counted and stay as they are; without groups rows are split
    marked = people.withColumn("split", F.when(F.col("id") < 53, "skipped_unknown"))
    for made in (splits.group_split(marked, "grp", 0.2), splits.row_split(marked, "id", 0.1), splits.group_split(marked.withColumn("grp", F.lit("")), "grp", 0.1, key="id")):
        assert made.columns == marked.columns and made.where("id < 53 and split <> 'skipped_unknown'").count() == 0 and made.where("id >= 53 and split in ('train', 'val')").count() == 50
    assert splits.row_split(marked, "id", 0.1).where("split = 'val'").count() == 5
    assert splits.group_split(marked.withColumn("grp", F.lit("")), "grp", 0.1, key="id").where("split = 'val'").count() == 5
    with pytest.raises(ValueError):
        splits.group_split(marked.withColumn("grp", F.lit("")), "grp", 0.1)


def test_derived_groups(spark):
    of = lambda names: [r["group"] for r in splits.derive_groups(spark.createDataFrame(list(enumerate(names)), "k long, name string"), "name").orderBy("k").collect()]
    assert of(["cat.jpg", "cat.png", "dog.jpg", "dog.png"]) == ["cat", "cat", "dog", "dog"]
    assert of(["a_1.jpg", "a-2.jpg", "a 3.x.jpg", "b.jpg", "c.jpg"]) == ["a", "a", "a", None, None]
    assert of(["a_1.jpg", "a_2.jpg", "b.jpg", "c.jpg", "d"]) == [None] * 5  # two of five are not half
    assert of(["_1", "_2", "x_1"]) == [None] * 3
    df = spark.createDataFrame([("x", None), ("y", "s1"), ("z", "")], "name string, subject_id string")
    assert [r["group"] for r in splits.derive_groups(df, "name").orderBy("name").collect()] == [None, "s1", None]


def test_balance_one_against_many(spark):
    df = spark.range(20_001).select("id", F.when(F.col("id") == 0, "few").otherwise("many").alias("kind"))
    got = splits.balance(df, ["kind"], "id")
    assert {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()} == {"few": 20_000, "many": 20_000}
    assert tuple(got.where("kind = 'few'").agg(F.min("copy_no"), F.max("copy_no"), F.count_distinct("copy_no")).first()) == (0, 19_999, 20_000)


def test_holdouts_balance_weights(people):
    m = people.withColumn("split", F.when(F.col("id") % 10 == 0, "test").otherwise("train"))
    made = splits.holdouts(m, "lang")
    assert made.count() == 206 and made.where("split = 'val' and lang <> holdout").count() == 0 and made.where("split = 'test'").count() == 22
    sizes = {r["lang"]: r["count"] for r in splits.balance(people, ["lang"], "id").groupBy("lang").count().collect()}
    assert len(set(sizes.values())) == 1
    w = {r["y"]: r["weight"] for r in splits.class_weights(people, "y").collect()}
    assert w[0] == pytest.approx(103 / (2 * 52)) and w[1] == pytest.approx(103 / (2 * 51))


def test_tuning_split():
    assert splits.tuning_split(["val", "test"], ["calibration", "val"], "test") == "val"
    assert splits.tuning_split(["test"], ["val"], "test") == "test"
    with pytest.raises(ValueError):
        splits.tuning_split(["train"], ["val"], "val")


def scores(spark, ys, ps):
    return spark.createDataFrame(list(zip(ys, map(float, ps))), "y int, p double")


def test_perfect_and_tied_curves(spark):
    df = scores(spark, [1, 1, 0, 0], [0.9, 0.8, 0.2, 0.1])
    assert E.auc(df).first()["roc_auc"] == 1.0
    assert E.auc(df, compat=True).first()["roc_auc"] == 0.875
    assert E.auc(scores(spark, [1, 0], [0.5, 0.5])).first()["roc_auc"] == 0.5


def test_areas_agree(spark):
    rng = random.Random(4)
    df = scores(spark, [rng.randint(0, 1) for _ in range(200)], [rng.randint(0, 20) / 20 for _ in range(200)])
    assert E.auc(df).first()["roc_auc"] == E.rank_auc(df).first()["roc_auc"]


def test_curves_by_definition(spark):
    """Areas under the points themselves, with many scores, few, one class only, and by group."""
    rng = random.Random(6)
    for n, kinds, classes in ((4000, 10**9, 2), (300, 7, 2), (50, 3, 1), (40, 5, 0), (1, 1, 2)):
        rows = [(f"g{k % 3}", rng.randint(0, 1) if classes == 2 else classes, rng.randrange(kinds) / kinds) for k in range(n)]
        df = spark.createDataFrame(rows, "grp string, y int, p double")
        for by in ([], ["grp"]):
            want = {}
            for g in sorted({r[0] for r in rows}) if by else [None]:
                mine = [(y, p) for grp, y, p in rows if g in (None, grp)]
                pos, neg = sum(y for y, _ in mine), sum(1 - y for y, _ in mine)
                roc, pr = [(0.0, 0.0)], [(0.0, 1.0)]
                for t in {p for _, p in mine}:
                    tp, fp = sum(y for y, p in mine if p >= t), sum(1 - y for y, p in mine if p >= t)
                    roc.append((fp / max(neg, 1), tp / max(pos, 1)))
                    pr.append((tp / max(pos, 1), tp / (tp + fp)))
                roc += [(1.0, 1.0)] if max(x for x, _ in roc) < 1 or max(y for _, y in roc) < 1 else []
                pr += [(1.0, pos / (pos + neg))] if max(x for x, _ in pr) < 1 else []
                want[g] = tuple(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(sorted(c), sorted(c)[1:])) for c in (roc, pr))
            got = {r["grp"] if by else None: (r["roc_auc"], r["pr_auc"]) for r in E.auc(df, by=by).collect()}
            assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=2e-6) for g in want), (n, kinds, classes, by)
    assert tuple(E.auc(df.where("false")).first()) == (0.0, 0.0)


def test_curves_without_one_task(spark):
    """A million distinct scores: no task reads more than a few slices of them."""
    df = spark.range(1_000_000).select((F.col("id") % 2).alias("y"), (F.xxhash64("id") / 2.0**64 + F.col("id") % 2 * 0.1).alias("p"))
    assert 0.55 < E.auc(df).first()["roc_auc"] == E.rank_auc(df).first()["roc_auc"]
    places = E._by_score(df, "y", "p", [], "__s").groupBy("__s").count().agg(F.max("count"), F.count("*")).first()
    assert places[0] < 40_000 and places[1] == E.SLICES
    best = E.select_threshold(df).first()
    assert best["objective"] > 0.09


def test_threshold_choice(spark):
    df = scores(spark, [1, 1, 0, 0], [0.9, 0.8, 0.2, 0.1])
    assert tuple(E.select_threshold(df).first()) == (0.8, 1.0)
    assert E.select_threshold(df, "f1").first()["threshold"] == 0.8
    tie = scores(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.6])
    assert E.select_threshold(tie).first()["threshold"] == 0.7
    assert math.isnan(E.select_threshold(df, "fixed", 0.3).first()["objective"])
    for bad in (lambda: E.select_threshold(df, "fixed"), lambda: E.select_threshold(df.where("false"))):
        with pytest.raises(ValueError):
            bad()


def test_golden_rates(spark):
    # counts of published results and the rates that belong to them
    for tp, tn, fp, fn, acc, prec, rec, f1 in ((386, 384, 6, 4, 0.98718, 0.98469, 0.98974, 0.98721), (389, 390, 0, 1, 0.99872, 1.0, 0.99744, 0.99872)):
        for strict in (True, False):
            r = E.with_rates(spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long"), strict).first()
            assert (round(r["accuracy"], 5), round(r["precision"], 5), round(r["recall"], 5), round(r["f1"], 5)) == (acc, prec, rec, f1)


def test_calibration(spark):
    df = scores(spark, [1, 0, 1, 0], [0.3, 0.05, 1.0, 1.5])
    bins = E.reliability(df).orderBy("bin").collect()
    assert len(bins) == 10 and bins[2]["n"] == 1 and bins[9]["n"] == 1 and sum(r["n"] for r in bins) == 3
    assert 0 <= E.ece(df).first()["ece"] <= 1
    rng = random.Random(2)
    ps = [rng.random() for _ in range(3000)]
    ys = [int(rng.random() < p) for p in ps]
    sharp = [1 / (1 + math.exp(-2.5 * math.log(max(p, 1e-6) / max(1 - p, 1e-6)))) for p in ps]
    given = scores(spark, ys, sharp)
    spark.sparkContext.setJobGroup("fit", "one job")
    t = E.fit_temperature(given)
    spark.sparkContext.setJobGroup("after", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit")) <= 2  # one query: its shuffle's map stage and its result
    assert t == pytest.approx(2.5, rel=0.1)
    z = np.log(np.clip(sharp, 1e-6, 1 - 1e-6) / (1 - np.clip(sharp, 1e-6, 1 - 1e-6))) * np.where(np.array(ys) == 1, 1, -1)
    loss = lambda v: np.logaddexp(0, -z / v).sum()
    assert all(loss(t) <= loss(t * f) + 1e-9 for f in (0.999, 1.001, 0.9, 1.1)) and E.fit_temperature(given, compat=True) == pytest.approx(2 * t, rel=1e-5)
    assert E.fit_temperature(scores(spark, [1, 0], [0.1, 0.9])) == pytest.approx(20, rel=1e-3) and E.fit_temperature(scores(spark, [1, 0], [0.9, 0.1])) == pytest.approx(0.05, rel=1e-3)
    with pytest.raises(ValueError):
        E.fit_temperature(given.where("false"))
    with pytest.raises(ValueError):
        E.apply_temperature(df, 0)
    with pytest.raises(ValueError):
        E.tune(df, split="test")
    assert E.tune(df, "fixed", 0.4) == {"temperature": None, "threshold": 0.4}


def test_ranking_and_patterns(spark):
    long = spark.createDataFrame([("a", "holdout", "balanced_accuracy", 0.8), ("a", "holdout", "balanced_accuracy", 0.6), ("a", "val", "balanced_accuracy", 0.9), ("b", "val", "balanced_accuracy", 0.7), ("c", "val", "f1", 1.0)], "run string, kind string, metric string, value double")
    runs = spark.createDataFrame([("a", "ok"), ("b", "dry_run"), ("c", "failed"), ("d", "ok")], "run string, status string")
    got = E.rank_runs(long, runs, "generalization_score", "balanced_accuracy").collect()
    assert [(r["run"], r["primary"]) for r in got] == [("a", 0.71), ("b", 0.7), ("d", float("-inf"))]
    wide = spark.createDataFrame([("a", "0.5", "0.7", "x")], "run string, holdout__u__f1 string, holdout__v__f1 string, holdout__w__f1 string")
    assert tuple(E.wide_pattern(wide, "f1").select("f1_mean", "f1_worst").first()) == (0.6, 0.5)


def test_governance(spark):
    config = G.Config.parse('{"held_out_splits": ["test"], "max_heldout_evals_per_day": 2, "selection_metric": "f1", "extra": 1}')
    assert config.more == {"extra": 1}
    with pytest.raises(ValueError):
        G.Config.parse("{}")
    for bad in ("[]", '{"a": 1, "b": 1}', '{"a": "x"}'):
        with pytest.raises(ValueError):
            G.label_mapping(bad)
    assert G.mapping_hash({"b": 1, "a": 0}) == G.mapping_hash({"a": 0, "b": 1})
    base = dict(manifest_path="m", label_mapping_hash="h", split_frozen=True, eval_split="test", tuning_split="val", forbid_test_tuning=True, drift=False, heldout_today=0, override=False)
    cases = [({}, "allowed"), (dict(manifest_path=" "), "manifest_required"), (dict(label_mapping_hash=None), "label_mapping_hash_required"), (dict(split_frozen=False), "split_policy_not_frozen"),
             (dict(tuning_split="test"), "held_out_tuning_forbidden"), (dict(tuning_split="test", override=True), "override_held_out_tuning"), (dict(drift=True), "hash_drift_blocked"),
             (dict(drift=True, override=True), "override_used_hash_drift"), (dict(heldout_today=2), "daily_heldout_limit_exceeded"), (dict(override=True), "override_used_hash_drift"), (dict(heldout_today=2, override=True), "override_daily_heldout_limit"), (dict(eval_split="val", heldout_today=9), "allowed")]
    schema = "manifest_path string, label_mapping_hash string, split_frozen boolean, eval_split string, tuning_split string, forbid_test_tuning boolean, drift boolean, heldout_today int, override boolean"
    got = G.decide(spark.createDataFrame([tuple({**base, **c}.values()) for c, _ in cases], schema), config).collect()
    assert [r["reason"] for r in got] == [r for _, r in cases]
    assert G.decide(spark.createDataFrame([tuple({**base, **dict(tuning_split="test", override=True)}.values())], schema), config, compat=True).first()["reason"] == "override_used_hash_drift"
    hashes = spark.createDataFrame([("a", "b", "c", None, "a", "x", "y", "d")], ", ".join(f"{s}_{k} string" for s in ("old", "new") for k in G.ARTIFACT_NAMES))
    message = G.drift_message(*({k: F.col(f"{s}_{k}") for k in G.ARTIFACT_NAMES} for s in ("old", "new")))
    one = spark.createDataFrame([tuple({**base, "drift": True}.values())], schema).crossJoin(hashes.select(message.alias("drift_message")))
    assert G.decide(one, config).first()["reason"] == "hash_drift_blocked: manifest hash mismatch (baseline=b, current=x); model hash mismatch (baseline=c, current=y)"
    decided = G.decide(spark.createDataFrame([tuple({**base, **c}.values()) for c, _ in cases], schema), config).withColumns({k: F.lit("h") for k in G.ARTIFACTS})
    none = spark.createDataFrame([], "artifact string, hash string")
    records, made = G.finalize(G.baseline_pending(decided, none), "run1", "ann", "2024-01-01T00:00:00Z")
    assert records.where("baseline_created").count() == 2 and tuple(made.collect()[0]) == ("2024-01-01T00:00:00Z", "ann", "run1", "h", "h", "h", "h")
    assert G.baseline_pending(decided, spark.createDataFrame([("m", "h")], none.schema)).where("baseline_pending").count() == 0
    log = G.access_record(spark, timestamp="2024-01-02", model_hash="m2", allowed=True, valid=True).unionByName(G.access_record(spark, timestamp="2024-01-01", model_hash="m1", manifest_hash="x", allowed=True, valid=True))
    assert {r["artifact"]: r["hash"] for r in G.pin_baseline(log).collect()} == {"manifest_hash": "x", "model_hash": "m1"}
    calls = []
    assert G.with_retries(lambda x: calls.append(x) or 1 / 0, 3)(5) is None and calls == [5, 5, 5]


def test_grids_against_numpy(spark):
    rng = np.random.default_rng(3)
    w, h = 6, 4
    x = rng.random((h, w))
    df = spark.createDataFrame([(1, x.ravel().tolist())], "k long, a array<double>")
    value = lambda c: np.array(df.select(c.alias("v")).first()["v"], float)

    def conv(kernel, edge):
        k = np.array(kernel, float)
        r = k.shape[0] // 2
        p = np.pad(x, r, mode="reflect" if edge == "mirror" else "constant")
        return np.array([[(p[i : i + 2 * r + 1, j : j + 2 * r + 1] * k).sum() for j in range(w)] for i in range(h)])

    gy, gx = conv(grid.SOBEL_Y, "mirror"), conv(grid.SOBEL_X, "mirror")
    edges = np.hypot(gy, gx)
    assert np.allclose(value(grid.sobel(F.col("a"), w, h)), (edges / (edges.max() + 1e-7)).ravel())
    c = df.select(grid.gradient_covariance(F.col("a"), w, h).alias("c")).first()["c"]
    assert np.allclose([c["xx"], c["xy"], c["yy"]], [(gx * gx).mean(), (gx * gy).mean(), (gy * gy).mean()])
    assert np.allclose(value(grid.noise_residual(F.col("a"), w, h)), conv(grid.HIGH_PASS, "zero").ravel())
    assert np.allclose(value(grid.flip(F.col("a"), w, h)), x[:, ::-1].ravel()) and np.allclose(value(grid.flip(F.col("a"), w, h, False)), x[::-1].ravel())
    assert np.allclose(value(grid.rot90(F.col("a"), w, h)), np.rot90(x).ravel())
    ll = (x[::2, ::2] + x[::2, 1::2] + x[1::2, ::2] + x[1::2, 1::2]) / 2
    hh = (x[::2, ::2] - x[::2, 1::2] - x[1::2, ::2] + x[1::2, 1::2]) / 2
    b = df.select(grid.haar(F.col("a"), w, h).alias("b")).first()["b"]
    assert np.allclose(b["ll"], ll.ravel()) and np.allclose(np.abs(b["hh"]), np.abs(hh).ravel())
    one_d = lambda v, m, wide: np.array([sum(max(0.0, 1 - abs(i - c) / wide) * v[i] for i in range(len(v))) / sum(max(0.0, 1 - abs(i - c) / wide) for i in range(len(v))) for c in ((j + 0.5) * len(v) / m - 0.5 for j in range(m))])
    for tw, th in ((3, 2), (13, 9), (6, 4), (4, 7)):
        for soft in (False, True):
            got = value(grid.resize(F.col("a"), w, h, tw, th, soft)).reshape(th, tw)
            rows = np.stack([one_d(c, th, max(1.0, h / th) if soft else 1.0) for c in x.T], axis=1)
            assert np.allclose(got, np.stack([one_d(r, tw, max(1.0, w / tw) if soft else 1.0) for r in rows]))
    small = grid.resample(F.col("a"), w, grid.area(h, h // 2), grid.area(w, w // 2))
    assert np.allclose(value(small), (ll / 2).ravel())
    back = value(grid.resize(small, w // 2, h // 2, w, h, True))
    assert np.allclose(value(grid.down_up(F.col("a"), w, h, (w // 2, h // 2))), back)
    lh, hl = (x[::2, ::2] + x[::2, 1::2] - x[1::2, ::2] - x[1::2, 1::2]) / 2, (x[::2, ::2] - x[::2, 1::2] + x[1::2, ::2] - x[1::2, 1::2]) / 2
    d = df.select(grid.haar_detail(F.col("a"), w, h).alias("d"), grid.haar_layer(F.col("a"), w, h).alias("l"), grid.haar_detail(F.col("a"), w, h, (w, h)).alias("f")).first()
    low, high = min(b.min() for b in (lh, hl, hh)), max(b.max() for b in (lh, hl, hh))
    most = max(np.abs(b).max() for b in (lh, hl, hh)) / 2
    for name, band in (("lh", lh), ("hl", hl), ("hh", hh)):
        assert np.allclose(d["d"][name], ((band - low) / (high - low + 1e-7)).ravel()) and np.allclose(d["l"][name], (np.abs(band) / 2 / (most + 1e-7)).ravel())
    full = np.array([d["f"][n] for n in ("lh", "hl", "hh")])
    assert full.shape == (3, w * h) and full.min() == 0 and full.max() == pytest.approx(1, abs=1e-6)
    rgb = df.select("k", *[F.transform("a", lambda v: (v * (j + 1)) % 1.0).alias(c) for j, c in enumerate("rgb")])  # noqa: B023
    seen = {m: rgb.select(grid.dispatch(F.col("r"), F.col("g"), F.col("b"), m, w, h).alias("v")).first()["v"] for m in grid.MODES}
    assert seen["sobel"]["r"] == seen["sobel"]["b"] and seen["wavelet"]["r"] != seen["wavelet"]["g"]
    for m in ("sobel", "wavelet"):
        for c in "rgb":
            assert np.allclose(seen["rgb+" + m][c], np.clip((np.array(seen["rgb"][c]) + np.array(seen[m][c])) / 2, 0, 1))
    levels = np.minimum(7, (x * 8).astype(int))
    want = np.zeros((8, 8), int)
    for i, j in zip(levels[:, :-1].ravel(), levels[:, 1:].ravel()):
        want[i, j] += 1
        want[j, i] += 1
    assert (value(grid.co_occurrence(grid.quantize(F.transform("a", lambda v: v * 256.0)), w, h)) == want.ravel()).all()
    s = np.log(np.abs(np.fft.fft2(x)) + 1e-8)
    assert df.select(grid.spectrum_features(F.col("a"), w, h).alias("s")).first()["s"]["variance"] == pytest.approx(s.var())
    noisy = value(grid.corrupt(F.col("a"), F.col("k"), "noise05", w, h))
    assert 0 < np.abs(noisy - x.ravel()).mean() < 0.15
    for bad in (lambda: grid.corrupt(F.col("a"), F.col("k"), "jpeg30", w, h), lambda: grid.dispatch(F.col("a"), F.col("a"), F.col("a"), "none", w, h)):
        with pytest.raises(ValueError):
            bad()


def test_tokens(spark):
    df = spark.createDataFrame([(1, "B a! a,b b"), (2, "c a"), (3, None), (4, "zz")], "id long, text string")
    vocab = tokens.vocabulary(df.where("id < 3"), "text", "id")
    assert {r["word"]: (r["n"], r["id"]) for r in vocab.collect()} == {"b": (3, 2), "a": (3, 3), "c": (1, 4)}
    ids = dict(map(tuple, tokens.encode(df, vocab, "text", "id", 4).collect()))
    assert ids == {1: [2, 3, 3, 2], 2: [4, 3, 0, 0], 3: [0, 0, 0, 0], 4: [1, 0, 0, 0]}
    pre = dict(map(tuple, tokens.encode(df, vocab, "text", "id", 3, "pre", "pre").collect()))
    assert pre[1] == [3, 2, 2] and pre[2] == [0, 4, 3]
    lines = spark.createDataFrame([("a 1 2",), ("c 0.5 x",), ("broken",)], "value string")
    got = tokens.align_vectors(vocab, lines, 2)
    assert {r["word"]: r["found"] for r in got.collect()} == {"a": True, "b": False, "c": True} and tokens.match_rate(got).first()[0] == 0.666667


def test_scoring_hooks(spark):
    def load():
        return lambda texts: [len(t) / 100 for t in texts]

    df = spark.createDataFrame([("long enough text",), ("short",), (None,)], "text string")
    assert [r["score"] for r in tokens.score_texts(df, load).collect()] == [0.16, None, None]

    def picky():
        def run(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no bad texts")
            return [1.0] * len(texts)

        return run

    mixed = spark.createDataFrame([(k, "a bad long text" if k == 3 else "a good long text") for k in range(8)], "k long, text string").coalesce(1)
    assert [r["score"] for r in tokens.score_texts(mixed, picky).orderBy("k").collect()] == [1.0] * 3 + [None] + [1.0] * 4
    assert [tuple(r) for r in tokens.score_errors(mixed, picky).collect()] == [(3, "a bad long text", "ValueError: no bad texts")]


def test_cross_validation(spark):
    rows = [(k, "good fine great words" if k % 2 else "bad poor awful terms", k % 2, k % 3) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, text string, y int, fold int")
    got = tokens.cross_validate(df, lambda: tokens.tfidf_pipeline(terms=50, max_iter=10))
    assert got.count() == 3 and got.where("accuracy < 1").count() == 0
    assert profile.mean_std(got.withColumn("run", F.lit("r")), "run", "f1").first()["mean"] == 1.0


def test_small_rules(spark):
    df = spark.createDataFrame([(None,), ("2",), ("1",)], "dataset_version string")
    assert profile.first_known(df, "dataset_version") == "1" and profile.first_known(df, "other") is None
    tokens.check_preprocessing("cnn", "sobel")
    with pytest.raises(ValueError):
        tokens.check_preprocessing("CLIP_vit_b32", "sobel")


def test_saved_models_come_back(spark, tmp_path):
    """A fitted pipeline that is saved, and loaded as by another session, gives the same scores and has the same vocabulary."""
    rows = spark.createDataFrame([(k, ("good fine great " if k % 2 else "bad poor awful ") * (1 + k % 3) + f"word{k % 5} common", k % 2) for k in range(40)], "id long, text string, y int")
    model = tokens.tfidf_pipeline(terms=50, max_iter=20).fit(rows)
    tables.save_model(model, f"{tmp_path}/model")
    tables.save_model(model, f"{tmp_path}/model")  # written again in place
    again = tables.load_model(f"{tmp_path}/model")
    assert again.stages[4].vocabulary == model.stages[4].vocabulary and again.stages[-1].coefficients == model.stages[-1].coefficients
    score = lambda m: [(r["id"], r["probability"], r["prediction"]) for r in m.transform(rows).orderBy("id").collect()]
    assert score(again) == score(model)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        tables.load_model(f"{tmp_path}/none")
