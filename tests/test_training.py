"""Draws, epochs and augmentation against definitions in Python and numpy."""

import colorsys
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import draws
from quern.operators import augment, epochs
from quern.plans import registry, training


def test_draws_are_uniform_and_free_of_order(spark):
    n = 40_000
    df = spark.range(n).select("id", draws.row_key(F.col("id"), 5, 1).alias("k"))
    made = df.select("id", draws.uniform(F.col("k"), "a").alias("u"), draws.uniform(F.col("k"), "b").alias("v"), draws.normal(F.col("k"), "z", 3).alias("z"))
    got = made.toPandas().sort_values("id")
    for c in "uv":
        hist = np.histogram(got[c], 50, (0, 1))[0]
        assert ((hist - n / 50) ** 2 / (n / 50)).sum() < 95 and got[c].between(0, 1, "left").all()  # 49 degrees of freedom
    pairs = np.histogram2d(got["u"], got["v"], 10)[0]
    assert ((pairs - n / 100) ** 2 / (n / 100)).sum() < 160
    assert abs(np.corrcoef(got["u"][:-1], got["u"][1:])[0, 1]) < 0.02
    assert abs(got["z"].mean()) < 0.02 and abs(got["z"].std() - 1) < 0.02 and abs((got["z"] ** 4).mean() - 3) < 0.2
    again = made.repartition(7, "u").toPandas().sort_values("id")
    assert (again.to_numpy() == got.to_numpy()).all()
    pixels = spark.range(64).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: draws.uniform(draws.row_key(F.col("id"), 5), "p", i))).alias("u")).toPandas()["u"]
    hist = np.histogram(pixels, 50, (0, 1))[0]
    assert ((hist - 640) ** 2 / 640).sum() < 95
    assert [r[0] for r in spark.range(50).select(draws.mixed(F.col("id"), 77, 99)).collect()] == [draws.mixed_py(k, 77, 99) for k in range(50)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 30_011])
def test_permutation(spark, n):
    df = spark.range(n).select("id", *[epochs.position(F.col("id"), n, s, e).alias(f"p{s}{e}") for s, e in ((1, 0), (1, 1), (2, 0))])
    got = df.toPandas()
    for c in got.columns[1:]:
        assert sorted(got[c]) == list(range(n))
    if n >= 1000:
        assert (got["p10"] == got["p11"]).sum() < 12 and (got["p10"] == got["p20"]).sum() < 12
        cells = np.histogram2d(got["id"], got["p10"], 10)[0]
        assert ((cells - n / 100) ** 2 / (n / 100)).sum() < 160
        assert abs(np.corrcoef(got["p10"][:-1], got["p10"][1:])[0, 1]) < 0.1


def test_position_of_strangers(spark):
    rows = spark.createDataFrame([(-1,), (10,), (None,), (3,)], "r long").select("r", epochs.position(F.col("r"), 10, 1, 1).alias("p")).collect()
    assert [r["p"] is None for r in rows] == [True, True, True, False]
    assert epochs.sides(1) == (1, 1) and all(a * b >= n > a * b - max(a, b) for n in (2, 10, 99, 100, 101, 10**12) for a, b in [epochs.sides(n)])


def test_epochs(spark, tmp_path):
    n = 1003
    spark.range(n).selectExpr("id", "id * 7 % 10 as y", "'x' as shard2").repartition(5).write.parquet(f"{tmp_path}/t")
    rows = epochs.numbered(spark, f"{tmp_path}/t")
    numbers = {r["id"]: r["row"] for r in rows.collect()}
    assert sorted(numbers.values()) == list(range(n)) and numbers == {r["id"]: r["row"] for r in epochs.numbered(spark, f"{tmp_path}/t").repartition(3).collect()}
    made = epochs.epoch(rows, n, 9, 0, shards=4, batch=10)
    plan = made._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(position" not in plan
    got = made.toPandas()
    assert sorted(got["id"]) == list(range(n))
    for shard, part in got.groupby("shard"):
        assert sorted(part["place"]) == list(range(len(part))) and len(part) in (250, 251) and (part["batch"] == part["place"] // 10).all()
    rest = epochs.epoch(rows, n, 9, 0, shards=4, batch=10, start=100).toPandas()
    assert sorted(rest["id"]) == sorted(got["id"][got["place"] >= 100])
    full = epochs.epoch(rows, n, 9, 0, shards=4, batch=8, drop_last=True).toPandas()
    assert set(full.groupby("shard").size()) == {248}
    parts = epochs.dealt(made, 4).withColumn("part", F.spark_partition_id()).select("part", "shard", "place").rdd.glom().collect()
    for k, part in enumerate(p for p in parts if p):
        assert {(r["part"], r["shard"]) for r in part} == {(k, k)} and [r["place"] for r in part] == list(range(len(part)))


def test_bad_rows_are_counted(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, -1.0), (4, 5.0)], "__good long, v double")
    kept, seen = epochs.counted(df, F.col("v") > 0)
    assert kept.columns == df.columns and [r[0] for r in kept.collect()] == [1, 4]
    assert seen.get == {"good": 2, "bad": 2}


def by_definition(image, c, w, h, noise):
    """The augmentation on whole arrays: scale, cut, flip, turn, colours by colorsys, blur by sums, noise as given, clip."""
    def scaled(g):
        out = np.zeros((c["tall"], c["wide"]))
        for i in range(c["tall"]):
            for j in range(c["wide"]):
                y = min(max((i + 0.5) * h / c["tall"] - 0.5, 0), h - 1)
                x = min(max((j + 0.5) * w / c["wide"] - 0.5, 0), w - 1)
                a, b = int(y), int(x)
                d, r = min(a + 1, h - 1), min(b + 1, w - 1)
                out[i, j] = (g[a, b] * (1 - x + b) + g[a, r] * (x - b)) * (1 - y + a) + (g[d, b] * (1 - x + b) + g[d, r] * (x - b)) * (y - a)
        return out

    planes = []
    for k in "rgb":
        g = scaled(np.array(image[k], float).reshape(h, w))[c["top"] : c["top"] + h, c["left"] : c["left"] + w]
        g = g[:, ::-1] if c["flip"] else g
        g = g[::-1] if c["upside"] else g
        g = np.rot90(g, c["turns"]) + c["brightness"]
        planes.append((g - g.mean()) * c["contrast"] + g.mean())
    if not (c["saturation"] == 1 and c["hue"] == 0):
        for y in range(h):
            for x in range(w):
                p = [float(g[y, x]) for g in planes]
                top = max(p)
                if top <= 0 or max(p) == min(p):
                    continue
                hue, s, v = colorsys.rgb_to_hsv(*p)
                # values may be a little below zero here, where colorsys has a saturation above one
                new = colorsys.hsv_to_rgb((hue + c["hue"]) % 1, min(1.0, s * c["saturation"]), v)
                for g, z in zip(planes, new):
                    g[y, x] = z
    if c["blur"]:
        soft = []
        for g in planes:
            p = np.pad(g, 1)
            soft.append(sum(p[i : i + h, j : j + w] for i in range(3) for j in range(3)) / 9)
        planes = soft
    if c["noise"]:
        for number, g in enumerate(planes):
            g += np.array([0.02 * noise(i * 3 + number) for i in range(w * h)]).reshape(h, w)
    return [np.clip(g, 0, 1).ravel() for g in planes]


def normal_by_definition(c, counter):
    u = []
    for stream in ("noise:radius", "noise:angle"):
        a, b = draws.round_keys("stream", stream)
        u.append(draws.mixed_py(counter, (c["one"] + a) % draws.PRIME, (c["two"] + b) % draws.PRIME) / 2**31)
    return math.sqrt(-2 * math.log(1 - u[0])) * math.cos(2 * math.pi * u[1])


@pytest.mark.parametrize("w,h", [(8, 8), (9, 5), (24, 24)])
def test_augmentation(spark, w, h):
    rng = np.random.default_rng(w)
    rows = [(k, [tuple(rng.random(w * h).tolist()) for _ in range(3)], ["doc", "Satellite ", "ff++", "chameleon", "street", None][k % 6]) for k in range(36)]
    df = spark.createDataFrame([(k, {"r": i[0], "g": i[1], "b": i[2]}, d) for k, i, d in rows] + [(99, None, "doc")], "k long, image struct<r:array<double>,g:array<double>,b:array<double>>, domain string")
    made = df.select("k", "image", "domain", augment.choices(F.col("k"), F.col("domain"), w, h, 3, 0).alias("c"), augment.augment(F.col("image"), F.col("k"), F.col("domain"), w, h, 3, 0).alias("out"))
    seen = {"flip": 0, "blur": 0, "noise": 0, "scaled": 0, "turned": 0}
    for r in made.collect():
        if r["image"] is None:
            assert r["out"] is None
            continue
        c = r["c"]
        for got, want in zip((r["out"][x] for x in "rgb"), by_definition(r["image"], c, w, h, lambda i: normal_by_definition(c, i))):  # noqa: B023
            assert np.allclose(got, want, atol=1e-9), (r["k"], r["domain"])
        for what, is_so in (("flip", c["flip"]), ("blur", c["blur"]), ("noise", c["noise"]), ("scaled", c["tall"] > h), ("turned", c["turns"])):
            seen[what] += bool(is_so)
        if r["domain"] == "doc":
            assert not c["flip"] and not c["blur"] and c["turns"] == 0 and c["saturation"] == 1 and abs(c["brightness"]) <= 0.05
    assert all(v for k, v in seen.items() if k != "scaled" or w > 9), seen


def test_choices_follow_their_domain(spark):
    df = spark.range(30_000).select("id", F.expr("element_at(array('doc', 'satellite', 'ff++', 'other'), cast(id % 4 as int) + 1)").alias("d"))
    c = df.select("d", augment.choices(F.col("id"), F.col("d"), 64, 64, 1, 2).alias("c")).select("d", "c.*").toPandas()
    part = {d: p for d, p in c.groupby("d")}
    near = lambda x, y: abs(x - y) < 0.025
    for d, s in (("doc", augment.DOCUMENT), ("satellite", augment.SATELLITE), ("ff++", augment.FACE), ("other", augment.GENERAL)):
        p = part[d]
        assert all(near(p[x].mean(), s[x]) for x in ("flip", "upside", "blur", "noise"))
        assert p["contrast"].between(*s["contrast"]).all() and near(p["contrast"].mean(), sum(s["contrast"]) / 2) and near(p["brightness"].std(), s["brightness"] / 3**0.5)
        assert near((p["turns"] == 3).mean(), s["turn"] / 4) and near((p["tall"] > 64).mean(), 0.5 - 0.5 / 6.4) and p["tall"].between(64, 70).all() and (p["top"] <= p["tall"] - 64).all()


def test_augmented_query_for_any_partitioning(spark, sf):
    """The registered query by definition over its whole table, and the same from another partitioning."""
    df = training.augmented_images(spark, sf)
    c = augment.choices(F.col("vec_id"), F.col("domain"), 8, 8, training._SEED, training._EPOCH)
    want = {r["vec_id"]: [round(float(x.sum()), 5) for x in by_definition(r["image"], r["c"], 8, 8, lambda i: normal_by_definition(r["c"], i))] for r in df.select("vec_id", "image", c.alias("c")).collect()}  # noqa: B023
    got = {r["vec_id"]: [r["r"], r["g"], r["b"]] for r in registry.QUERIES["augmented"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-5) for k in got)
    a = augment.augment(F.col("image"), F.col("vec_id"), F.col("domain"), 8, 8, 1, 1)
    one, two = ({r["vec_id"]: r["a"] for r in x.select("vec_id", a.alias("a")).collect()} for x in (df, df.repartition(5, "domain")))
    assert one == two
