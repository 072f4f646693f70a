"""Images from bytes, and sources of labelled texts."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import grid
from quern.sources import adapters, images


def png(pixels: np.ndarray, colour: int, depth: int = 8, kinds=(0,), palette: bytes = b"") -> bytes:
    """pixels: rows of samples. Filters rows by the definition of the format."""
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8)
    if depth == 16:
        rows = np.repeat(pixels, 2, axis=1)
    elif depth < 8:
        bits = (pixels[:, :, None] >> np.arange(depth)[::-1] & 1).reshape(len(pixels), -1).astype(np.uint8)
        rows = np.packbits(bits, axis=1)
    else:
        rows = pixels
    body = b""
    for y, line in enumerate(rows.tolist()):
        kind, up = kinds[y % len(kinds)], rows[y - 1].tolist() if y else [0] * rows.shape[1]
        out = []
        for k, v in enumerate(line):
            a, c = (line[k - step], up[k - step]) if k >= step else (0, 0)
            b, p = up[k], a + up[k] - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, best)[kind]) % 256)
        body += bytes([kind, *out])
    width = pixels.shape[1] // {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, len(pixels), depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_decoding():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    flat = rgb.reshape(7, 15)
    assert (images.decode(png(flat, 2, kinds=range(5))) == rgb).all()
    assert (images.decode(png(flat, 2, 16, kinds=range(5))) == rgb).all()
    rgba = np.concatenate([rgb, rng.integers(0, 256, (7, 5, 1), dtype=np.uint8)], axis=2).reshape(7, 20)
    assert (images.decode(png(rgba, 6, kinds=(4, 3, 1))) == rgb).all()
    grey = rgb[:, :, 0]
    assert (images.decode(png(grey, 0, kinds=(1, 2))) == grey[:, :, None]).all()
    assert (images.decode(png(np.stack([grey, grey], axis=2).reshape(7, 10), 4)) == grey[:, :, None]).all()
    few = grey % 4
    assert (images.decode(png(few, 0, 2)) == (few * 85)[:, :, None]).all()
    table = rng.integers(0, 256, (4, 3), dtype=np.uint8)
    assert (images.decode(png(few, 3, 2, palette=table.tobytes())) == table[few]).all()
    padded = np.zeros((7, 16), np.uint8)
    padded[:, :15] = rgb[::-1, :, ::-1].reshape(7, 15)
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + padded.size, 0, 0, 54, 40, 5, 7, 1, 24, 0, 0, 0, 0, 0, 0) + padded.tobytes()
    assert (images.decode(bmp) == rgb).all()
    assert (images.decode(b"P6 # a note\n5 7\n255\n" + rgb.tobytes()) == rgb).all() and (images.decode(b"P5\n5 7 255\n" + grey.tobytes()) == grey[:, :, None]).all()
    good = png(flat, 2)
    for bad in (b"", b"hello", good[:40], good[:-20], good.replace(b"IDAT", b"IDAS"), b"\xff\xd8\xff\xe0jpeg", b"BM" + bytes(60), b"P6\n5 7\n255\nxx", png(few, 3, 2, palette=table[:2].tobytes())):
        with pytest.raises(ValueError):
            images.decode(bad)


def test_images_become_grids(spark):
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (12, 20, 3), dtype=np.uint8)
    data = [("a", bytearray(png(rgb.reshape(12, 60), 2))), ("b", bytearray(b"\xff\xd8\xff")), ("c", None)]
    made = images.with_image(spark.createDataFrame(data, "path string, content binary"), size=(8, 6))
    got = {r["path"]: r["image"] for r in made.collect()}
    assert (got["a"]["width"], got["a"]["height"], got["a"]["reason"]) == (20, 12, None) and len(got["a"]["r"]) == 48
    assert got["b"]["reason"] == "no codec for jpeg" and got["b"]["r"] is None and got["c"]["reason"] == "null"
    # the same resize as the grid operators'
    full = spark.createDataFrame([(rgb[:, :, 0].astype(float).ravel().tolist(),)], "a array<double>")
    want = np.array(full.select(grid.resize(F.col("a"), 20, 12, 8, 6, True).alias("v")).first()["v"]) / 255
    assert np.allclose(got["a"]["r"], want, atol=1e-6)
    modes = made.where("path = 'a'").select(*[grid.dispatch(F.col("image.r"), F.col("image.g"), F.col("image.b"), m, 8, 6).alias(m.replace("+", "_")) for m in grid.MODES]).first()
    assert all(len(modes[m.replace("+", "_")][c]) == 48 for m in grid.MODES for c in "rgb")


LONG = "these are ten words of a text that is long enough"


def test_adapters(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    cases = {
        "capital_text": (frame([(LONG, "1"), (LONG, "1"), ("short", "0"), (None, "1"), (LONG + " [AI made]", "0.0")], "Text string, generated string"), {(LONG, 1), (LONG, 0)}),
        "students": (frame([(LONG, "student"), (LONG, "Student"), (LONG + " x", "ai")], "Text string, Label string"), {(LONG, 0), (LONG + " x", 1)}),
        "named_or_numbered": (frame([(LONG, " Human "), (LONG + " y", "1"), (LONG + " z", "?")], "text string, label string"), {(LONG, 0), (LONG + " y", 1)}),
        "numbered": (frame([(LONG, 1), (LONG, 0)], "text string, label int"), {(LONG, 0), (LONG, 1)}),
        "authors": (frame([(LONG, "AI")], "content_text string, author_type string"), {(LONG, 1)}),
        "by_source": (frame([(1, LONG, "human")], "id int, text string, source string"), {(LONG, 0)}),
        "answers": (frame([(f'["{LONG}", " ", 3]', f'["  {LONG}  "]'), ("broken", None)], "human_answers string, chatgpt_answers string"), {(LONG, 0), (LONG, 1)}),
        "canonical": (frame([(f"a  {LONG}\n\t!", 1)], "text string, isGenerated int"), {(f"a {LONG} !", 1)}),
    }
    for name, (df, want) in cases.items():
        got = adapters.clean(adapters.canonical(df, adapters.SHAPES[name])).collect()
        assert len(got) == len(want) and {(r["text"], r["is_generated"]) for r in got} == want, name


def test_corpus_build(spark):
    rows = lambda *ts, y=0: spark.createDataFrame([(t, y) for t in ts], "text string, is_generated int")
    human = adapters.combine_human({"books": rows("one", "two", "both of us"), "forum": rows("two", "three")})
    assert sorted(r["text"] for r in human.collect()) == ["both of us", "one", "three", "two"]
    wordy = " ".join(f"w{k}" for k in range(60))
    raw = spark.createDataFrame([(f"Here is the essay:\n**So, basically,** {wordy} I hope this helps.", 1, "p"), ("too short", 1, "p"), (None, 1, "p"), ("", 1, "q")], "text string, is_generated int, prompt_used string")
    made = adapters.clean_synthetic(raw)
    assert made.columns == raw.columns and [r["text"] for r in made.collect()] == ["W0 " + " ".join(f"w{k}" for k in range(1, 60))]
    corpus, report = adapters.merge(human, rows("both of us", "new", y=1))
    assert corpus.count() == 6 and adapters.shares(corpus).count() == 2
    got = {r["part"]: (r["rows"], r["blank"], r["repeated"], list(r["labels"]), r["in_both"]) for r in report.collect()}
    assert got == {"human": (4, 0, 0, [0], 1), "synthetic": (2, 0, 0, [1], 1)}
    assert [r["text"] for r in corpus.collect()] == [r["text"] for r in adapters.merge(human.orderBy("text"), rows("new", "both of us", y=1))[0].collect()]


def test_reports(spark, tmp_path):
    from quern.operators import evaluation
    from quern.sources import reports

    df = spark.createDataFrame([(1, 0.9, "a"), (0, 0.2, "a"), (1, 0.4, "b"), (0, 0.6, "b")], "y int, p double, domain string")
    metrics = evaluation.bundle(df).crossJoin(evaluation.ece(df))
    facts = dict(split="test", dataset_id=None, domain=None, manifest="m.csv", seed=42, preprocessing="rgb", policy="youden", threshold=0.5, calibration="none", allowed=True, reason="allowed", override=False, tuning_split="val", model="m")
    text = reports.summary("r1", facts, metrics)
    assert text.startswith("# Evaluation Summary - r1\n\n- Split: `test`\n- Dataset filter: `None`") and "- Selected threshold: `0.500000`\n" in text
    assert "## Confusion Matrix\n\n- TN: `1`\n- FP: `1`\n- FN: `1`\n- TP: `1`\n" in text and "- Accuracy: `0.500000`\n" in text
    table = reports.slice_summary("r1", facts, evaluation.slices(df, ["domain"]))
    assert "## By `domain`\n\n| Slice | Samples | Accuracy |" in table and "| b | 2 | 0.0000 |" in table and table.index("| b |") < table.index("| a |")
    paths = reports.write_report(spark, f"file://{tmp_path}/out", "r1", {"a": 1}, text)
    assert [p.split("/")[-1] for p in paths] == ["r1_metrics.json", "r1_summary.md"] and (tmp_path / "out" / "r1_summary.md").read_text() == text
    with pytest.raises(ValueError):
        reports.summary("r1", facts, df)
    paths = reports.write_report(spark, f"file://{tmp_path}/out", "r1", {"b": 2}, table, kind="slices")
    assert [p.split("/")[-1] for p in paths] == ["r1_slices.json", "r1_slices.md"] and (tmp_path / "out" / "r1_summary.md").read_text() == text  # the summary stays
    kinds = df.withColumn("corruption", F.lit("noise05")).unionByName(df.withColumn("corruption", F.lit("blur"))).unionByName(df.withColumn("corruption", F.lit("jpeg50"))).unionByName(df.withColumn("corruption", F.lit("other")))
    results = evaluation.corruption_report(kinds).join(evaluation.ece(df).crossJoin(kinds.select("corruption").distinct()), "corruption").drop("ece").crossJoin(evaluation.ece(df))
    rough = reports.corruption_summary("r1", facts, results)
    lines = rough.splitlines()
    assert lines[0] == "# Corruption Evaluation - r1" and lines[2:8] == ["- Split: `test`", "- Manifest: `m.csv`", "- Model: `m`", "- Preprocessing mode: `rgb`", "- Dataset filter: `None`", "- Domain filter: `None`"]
    assert lines[9] == "| Corruption | ROC-AUC | PR-AUC | Accuracy | Balanced Acc. | ECE | Brier |" and lines[10] == "| --- | ---: | ---: | ---: | ---: | ---: | ---: |"
    assert [x.split(" | ")[0] for x in lines[11:]] == ["| jpeg50", "| blur", "| noise", "| other"] and lines[11].split(" | ")[3] == "0.5000" and rough.endswith("|\n")
    paths = reports.write_report(spark, f"file://{tmp_path}/out", "r1", {}, rough, kind="corruptions")
    assert [p.split("/")[-1] for p in paths] == ["r1_corruptions.json", "r1_corruptions.md"]


def test_fallbacks(spark, tmp_path):
    from quern.sources import files

    df = spark.createDataFrame([("x" * 10, "y" * 300, "z" * 400), (None, "short", None)], "a string, b string, c string")
    assert [r[0] and r[0][0] for r in df.select(files.first_long_enough(["a", "b", "c"])).collect()] == ["y", None]
    calls = []

    def broken():
        calls.append("broken")
        return spark.read.parquet(f"{tmp_path}/nothing")

    def works():
        calls.append("works")
        return spark.createDataFrame([(1, ["a", "b"])], "k int, answers array<string>")

    for _ in range(2):
        assert [tuple(r) for r in files.present_or_load(spark, f"{tmp_path}/table", [broken, works]).collect()] == [(1, '["a","b"]')]
    assert calls == ["broken", "works"]
    with pytest.raises(Exception):
        files.present_or_load(spark, f"{tmp_path}/other", [broken])
