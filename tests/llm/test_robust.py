"""Clashing names, broken media, models against definitions, and the pipeline on tables that have little or nothing in them."""

import hashlib
import importlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quern.llm")
from quern.llm import decontam, langid, media, packing, secrets, shared, simhash, wordpiece  # noqa: E402

TEXT = "one two three four five six seven eight nine ten eleven twelve Zk3x9Qp7Lm2Vt8Rw4Ys6Bn1 token=abcdef"
NAMES = ["__quern_" + n for n in ("text", "base", "cand", "hits", "assign", "access", "hex", "matches", "gaps", "values", "places", "spans", "cuts", "lang_id")]


@pytest.fixture(scope="module")
def clashing(spark):
    """A column for every temporary name that the operators use, in another case too, and for names of their results."""
    more = [*NAMES, "__QUERN_SPANS_", "g", "fp", "bucket", "node", "root", "media", "n_bytes", "length", "task", "spans", "h", "x", "acc", "best", "k", "d", "b"]
    rows = [(1, TEXT, "en", *range(len(more))), (None, None, None, *range(len(more))), (3, "", "en", *range(len(more)))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` int" for c in more))


def test_clashing_names(spark, clashing):
    items = spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    for out in (
        secrets.redact(clashing), secrets.find_spans(clashing, out="found").drop("found"), langid.keep_known(clashing), simhash.keep_one(clashing),
        decontam.decontaminate(clashing, items), decontam.decontaminate(clashing, items, "spans"), media.store_media(clashing, out="png").drop("png"),
    ):
        assert out.columns == clashing.columns
        for r in out.collect():
            assert [r[c] for c in out.columns[3:]] == list(range(len(out.columns) - 3))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(clashing).collect()}
    assert clean[1].endswith("twelve [SECRET] [SECRET]") and clean[None] is None and clean[3] == ""
    for digest in (secrets.digest, media.media_digest, wordpiece.count_tokens, packing.pack_documents):
        assert digest(clashing).count() == 3


def png(header: bytes, data: bytes) -> bytes:
    return media.SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"IDAT", data) + media._chunk(b"IEND", b"")


def test_broken_images(spark):
    head = lambda w, h: struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    good = png(head(3, 1), zlib.compress(b"\0abc"))
    broken = {
        "short header": png(head(3, 1)[:-1], zlib.compress(b"\0abc")), "no data": png(head(3, 1), b""), "too little": png(head(3, 2), zlib.compress(b"\0abc")),
        "too much": png(head(3, 1), zlib.compress(b"\0abcd" * 1000)), "a bomb": png(head(3, 1), zlib.compress(bytes(50_000_000))), "zero": png(head(0, 0), zlib.compress(b"")),
        "huge header": png(head(2**31, 2**31), zlib.compress(bytes(1000))), "cut stream": png(head(3, 1), zlib.compress(b"\0abc")[:-5]), "cut": good[:-3], "empty": b"", "text": b"hello",
        "stream checksum": png(head(3, 1), zlib.compress(b"\0abc")[:-4] + b"\0\0\0\0"), "filter": png(head(3, 1), zlib.compress(b"\7abc")),
    }
    assert media.decode_png(good)[0].tobytes() == b"abc"
    for name, data in broken.items():
        with pytest.raises(ValueError):
            media.decode_png(data)
            raise AssertionError(name)
    df = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate([good, *broken.values()])] + [(99, None)], "doc_id long, media binary")
    assert [bytes(r["payload"]) if r["payload"] is not None else None for r in media.read_media(df).orderBy("doc_id").collect()] == [b"abc"] + [None] * (len(broken) + 1)
    from pyspark.sql import functions as F

    got = media.described(df.withColumn("n_bytes", F.lit(0))).orderBy("doc_id").collect()
    assert [r["payload_bytes"] for r in got] == [3] + [None] * (len(broken) + 1)


def naive_feature(samples: np.ndarray) -> str:
    """The hash by its definition: area means by overlap, cosines summed term by term."""
    h, w = samples.shape
    grey = samples.reshape(h, w // 3, 3).astype(float).sum(axis=2) / 3

    def mean(n, to):
        out = np.zeros((to, n))
        for i in range(to):
            for j in range(n):
                out[i, j] = max(0.0, min((i + 1) * n / to, j + 1) - max(i * n / to, j)) * to / n
        return out

    small = mean(h, 32) @ grey @ mean(w // 3, 32).T
    low = [[round(sum(small[y, x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)), 6) for v in range(8)] for u in range(8)]
    flat = [c for row in low for c in row]
    rest = sorted(flat[1:])
    return f"{int(''.join('1' if c > rest[31] else '0' for c in flat), 2):016x}"


def test_media_digest_by_definition(spark):
    texts = [None, "", "a", "é" * 300, "plain words " * 700, "".join(chr(32 + k * k % 90) for k in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.store_media(df).collect()}
    for r in media.media_digest(df).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-16:]) and r["feature"] == naive_feature(np.frombuffer(padded, np.uint8).reshape(-1, 192))
        assert r["media_bytes"] == len(stored[r["doc_id"]]) and r["media_sha256"] == hashlib.sha256(stored[r["doc_id"]]).hexdigest()


class KneserNey:
    """The model by its definition, on dictionaries of strings."""

    def __init__(self, texts, letters):
        self.size, self.counts = letters, defaultdict(Counter)
        top = Counter()
        for t in texts:
            x = " " * (langid.ORDER - 1) + t + " "
            top.update(x[i : i + langid.ORDER] for i in range(len(x) - langid.ORDER + 1))
        for k in range(langid.ORDER, 0, -1):
            self.counts[k] = top
            top = Counter(g[1:] for g in top)

    def p(self, gram):
        if not gram:
            return 1 / self.size
        counts = self.counts[len(gram)]
        n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
        cut = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        lower = self.p(gram[1:])
        return lower if not same else max(counts[gram] - cut, 0) / sum(same) + cut * len(same) / sum(same) * lower


def test_kneser_ney_by_definition():
    texts = {"xx": ["the cat sat on the mat", "the dog ran and the cat sat", "a hat"], "yy": ["der hund und die katze", "die katze sass", "ein hut und ein hund"]}
    grams = [(lang, "".join(chr(c) for c in x[i : i + langid.ORDER])) for lang, ts in texts.items() for t in ts for x in [langid.read([t])[0]] for i in range(len(t) + 1)]
    model = langid.Model(pd.DataFrame([(*k, n) for k, n in Counter(grams).items()], columns=["lang", "gram", "n"]))
    letters = sorted({c for ts in texts.values() for t in ts for c in t})
    plain = {lang: KneserNey(ts, len(letters) + 1) for lang, ts in texts.items()}
    for context in ("   ", "the", " de", "zzz", "at ", "ein", "xqt"):
        for j, lang in enumerate(model.names):
            got = [float(np.exp(model._look(np.array([[ord(c) for c in context + x]], np.uint32)))[0, j]) for x in letters + ["Q"]]
            want = [plain[lang].p(context + x) for x in letters + ["Q"]]
            assert np.allclose(got, want, rtol=1e-9)
            assert abs(sum(want) - 1) < 1e-9  # Q stands for every other letter
    ce, n = model.entropies(["the hat", "", None])
    by_hand = [-sum(math.log(plain[lang].p(f"   the hat "[i : i + 4])) for i in range(8)) / 8 for lang in model.names]
    assert np.allclose(ce[0], by_hand) and n.tolist() == [7, 0, 0]


def test_small_languages(spark):
    rows = [(k, f"the cat sat on the mat and the dog ran {k}", "en") for k in range(60)] + [(k, "der hund und die katze sind zu haus", "de") for k in (100, 101, 102, 103)]
    rows += [(k, "le chat est sur la table", "fr") for k in range(200, 240)] + [(1, "the cat", "en")] * 50  # one row many times
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    learned = {r["lang"] for r in df.where(~langid.held_out()).select("lang").distinct().collect()}
    assert set(model.names) == learned == {"en", "de", "fr"} and np.isfinite(model.deviation).all() and np.isfinite(model.mean).all()
    got = model.predict(["die katze und der hund", "the dog sat", "le chat", "12"])
    assert got["lang_pred"].tolist() == ["de", "en", "fr", "und"]
    dirty = df.unionByName(spark.range(3000).selectExpr("id as doc_id", "'qq' as text", "concat('stray ', id) as lang"))
    many = langid.train(dirty)  # of more languages those with the most rows are learned
    assert len(many.names) == langid.LANGUAGES and {"en", "de", "fr"} <= set(many.names)
    assert many.predict(["die katze und der hund", "le chat est sur"])["lang_pred"].tolist() == ["de", "fr"]


JUNK = {
    "hex": "4f3a9b1c7d2e8f60" * 100, "base64": "Zk3x9Qp7Lm2Vt8Rw4Ys6Bn1HcJdKfGgAaEeUuOoIi0qXzTvWyPbNrSlMhD5C+/" * 30, "greek": "αβγδε ζηθικ λμνξο " * 30, "cyrillic": "привет как дела сегодня " * 20, "han": "中文文本测试数据 " * 30,
}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_junk_is_rejected_and_clean_text_is_not(spark, size):
    """The same at every size: noise is rejected, of clean rows held out one in a hundred at the most; the limit hardly moves."""
    import random

    draw = random.Random(3)
    junk = JUNK | {"random hex": f"{draw.getrandbits(4000):x}", "letters": "".join(draw.choices("abcdefghijklmnopqrstuvwxyz    ", k=900)), "short letters": "".join(draw.choices("abcdefghijklmnopqrstuvwxyz    ", k=120))}
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    model = langid.train(docs)
    assert model.predict(list(junk.values()))["rejected"].all() and ((model.limit >= langid.FLOOR) & (model.limit <= 2 * langid.FLOOR)).all()
    found = langid.digest(docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["rejected"] for r in found) <= 0.01 * len(found) and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)


def test_language_query_by_definition(spark):
    """Predictions and rejections of the smallest table by dictionaries: the models, their calibration, every row."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    hashed = {r[0]: r for r in docs.selectExpr("doc_id", "xxhash64(cast(doc_id as string), text, 5) as h", "pmod(xxhash64(xxhash64(cast(doc_id as string), text, 5)), 2) as half").collect()}

    def letters(text):
        return " ".join(w for w in "".join(c.lower()[0] if c.isalpha() else " " for c in text).split(" ") if w) + (" " if text and not text[-1].isalpha() else "")

    learn = [(d, t, lang) for d, t, lang in rows if zlib.crc32(str(d).encode()) % 3 != 1 and lang is not None]
    kept = [(t, lang) for d, t, lang in learn if hashed[d]["half"] != 0]
    aside = [(t, lang) for d, t, lang in learn if hashed[d]["half"] == 0]
    names = sorted({lang for _, lang in kept})
    alphabet = {c for t, _ in kept for c in letters(t) + " "}
    models = {lang: KneserNey([letters(t) for t, x in kept if x == lang], len(alphabet) + 1) for lang in names}
    heads = {lang: {k: defaultdict(list) for k in range(1, langid.ORDER + 1)} for lang in names}
    for lang in names:
        for k in heads[lang]:
            for g, c in models[lang].counts[k].items():
                heads[lang][k][g[:-1]].append(c)
    cuts = {lang: {k: (lambda n1, n2: n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)(*(sum(c == j for c in models[lang].counts[k].values()) for j in (1, 2))) for k in heads[lang]} for lang in names}
    memo = {}

    def p(lang, gram):
        if not gram:
            return 1 / models[lang].size
        if (lang, gram) not in memo:
            same, cut, lower = heads[lang][len(gram)].get(gram[:-1]), cuts[lang][len(gram)], p(lang, gram[1:])
            memo[lang, gram] = lower if not same else max(models[lang].counts[len(gram)][gram] - cut, 0) / sum(same) + cut * len(same) / sum(same) * lower
        return memo[lang, gram]

    def entropies(text):
        x = "   " + letters(text) + " "
        return {lang: -sum(math.log(p(lang, x[i : i + 4])) for i in range(len(x) - 3)) / (len(x) - 3) for lang in names}, len(x) - 4

    widen = lambda n: math.sqrt(1 + 400 / n)
    own = defaultdict(list)
    for t, lang in aside:
        if lang in names and any(c.isalpha() for c in t):
            ce, n = entropies(t)
            own[lang].append((ce[lang], n))
    sure = {lang: v for lang, v in own.items() if len(v) >= langid.LEAST}
    centre = {lang: float(np.median([c for c, _ in v])) for lang, v in sure.items()}
    spread = {lang: max(langid.LEAST_DEVIATION, 1.4826 * float(np.median([abs(c - centre[lang]) / widen(n) for c, n in v]))) for lang, v in sure.items()}
    middle = lambda d: float(np.median(list(d.values())))
    got = {r["doc_id"]: r for r in langid.digest(docs, langid.train(docs)).collect()}
    assert len(sure) >= 1
    for d, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert got[d]["lang_pred"] == "und" and got[d]["rejected"]
            continue
        ce, n = entropies(t)
        best = min(names, key=lambda x: (ce[x], x))
        assert got[d]["lang_pred"] == best and abs(got[d]["cross_entropy"] - ce[best]) < 1e-9
        far = (ce[best] - centre.get(best, middle(centre))) / (spread.get(best, middle(spread)) * widen(n))
        assert abs(far - langid.FLOOR) < 1e-6 or got[d]["rejected"] == (far > langid.FLOOR)  # too few texts for another limit


def test_long_texts_in_pieces(monkeypatch):
    """Any cut into pieces gives the same numbers, and a text of forty million characters is held a piece at a time."""
    import random
    import resource

    from .test_cores import _model

    m, draw = _model(), random.Random(4)
    texts = ["".join(draw.choices(["the ", "hund", " ", "...", "Katze", "é", "12", "\n"], k=draw.randint(0, 60))) for _ in range(40)] + [None, "", "...", "a", " a", "a "]
    want = m.entropies(texts)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "CHUNK", size)
        got = m.entropies(texts)
        assert np.allclose(got[0], want[0], atol=1e-9) and (got[1] == want[1]).all()
    monkeypatch.undo()
    long = "the cat sat on the mat " * 1_800_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert m.predict([long])["lang_pred"].tolist() == ["xx"]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kilobytes


@pytest.mark.parametrize("kind", ["empty", "nulls", "repeated", "no items"])
def test_pipeline_on_little(spark, tmp_path, kind):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    if kind == "empty":
        docs = docs.where("false")
    elif kind == "nulls":
        some = docs.limit(30).selectExpr("cast(null as bigint) as doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
        docs = docs.unionByName(some).unionByName(docs.limit(5).selectExpr("doc_id + 1000 as doc_id", "cast(null as string) as text", "lang", "cast(null as string) as source", "n_chars"))
    elif kind == "repeated":
        docs = docs.unionByName(docs).unionByName(docs)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    (bench.where("false") if kind == "no items" else bench).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert (len(got) == 0) == (kind == "empty")
    whole = Counter((r["doc_id"], r["piece"]) for r in got)
    assert max(whole.values(), default=1) == 1  # of equal rows one is left
    shared.release(spark)


def test_scopes_are_per_thread(spark):
    import threading

    with shared.scope() as keep:
        outer = keep(shared.stage(spark.range(3), "outer"))
        seen = []

        def other():
            shared.stage(spark.range(4), "other")
            shared.release(spark)
            seen.append(outer.count())

        t = threading.Thread(target=other)
        t.start()
        t.join()
        with shared.scope():
            lost = shared.stage(spark.range(5), "lost")
        with pytest.raises(Exception):
            lost.count()
    assert seen == [3] and outer.count() == 3
    shared.release(spark)
    with pytest.raises(Exception):
        outer.count()


def test_many_equal_short_rows(spark):
    """Empty and short texts under one id spread over the groups, and come back once each."""
    from quern.llm import substring, suffix

    words = " ".join(f"w{k}" for k in range(40))
    df = spark.range(3000, numPartitions=5).selectExpr("cast(null as bigint) as doc_id", "case when id % 3 = 0 then null when id % 3 = 1 then '' else 'one two' end as text").unionByName(
        spark.createDataFrame([(1, words), (2, words)], "doc_id long, text string"))
    base, n, _ = shared.grouped(df, 25)
    assert max(r["count"] for r in base.groupBy("g").count().collect()) < 200 and n == 64
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(df).collect())
    assert got == {(None, 0, 0): 2000, (None, 2, 0): 1000, (1, 40, 0): 1, (2, 40, 40): 1}
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix.remove_repeats(df).collect())
    size = len(words)
    assert got == {(None, 0, 0): 2000, (None, 7, 0): 1000, (1, size, 0): 1, (2, size, size): 1}


def test_groups_follow_from_rows_alone(spark):
    """Which group a text is in does not depend on the order or the partition that it is read in: a task that runs again after its input
    came in another order deals its rows as before, so none is lost or doubled. Short texts are in no group."""
    import random

    from quern.llm import substring, suffix

    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdef", k=draw.randint(1, 6)))
    texts = [" ".join(word() for _ in range(draw.choice([0, 3, 12, 13, 40]))) for _ in range(60)]
    rows = [(k, draw.choice(texts)) for k in range(120)] + [(5, None)] * 30 + [(5, "x y")] * 30 + [(None, "x")] * 10 + [(7, texts[0])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for make in (lambda d: substring.remove_repeats(d, group_bytes=500), lambda d: suffix.remove_repeats(d, group_bytes=500)):
        results = [Counter(map(tuple, make(d).collect())) for d in (df, df.repartition(7), df.orderBy(F.rand(3)).coalesce(2))]
        assert results[0] == results[1] == results[2] and sum(results[0].values()) == len(rows)
        assert "monotonically_increasing_id" not in make(df.repartition(3))._jdf.queryExecution().toString()
    long, short, n, _ = shared.grouped(df, 25, 500)
    dealt = [{(r["doc_id"], r["text"], r["g"]) for r in shared.grouped(d, 25, 500)[0].collect()} for d in (df, df.repartition(5, "text"))]
    assert dealt[0] == dealt[1] and long.count() + short.count() == len(rows) and all(len((r["text"] or "").encode()) < 25 for r in short.collect())
