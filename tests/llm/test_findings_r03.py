"""Small cases of round 3's findings about training-data operators."""

import random
import tracemalloc

import pytest

from quern.llm import langid, minhash, simhash


def cousins(families=6, members=40, words=60, seed=5):
    """Families of texts, each a base with some words changed: many pairs lie on both sides of the limit."""
    draw, rows = random.Random(seed), []
    for f in range(families):
        base = [f"f{f}w{k}" for k in range(words)]
        for m in range(members):
            made = list(base)
            for _ in range(draw.randint(0, 2)):
                made[draw.randrange(words)] = f"x{f}_{m}_{draw.random()}"
            rows.append((len(rows), " ".join(made) + (" the line that all of them have" if m % 2 else "")))
    return rows


def components_of(rows):
    """The least id of each text's component, all pairs compared."""
    sets = [frozenset(minhash.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {rows[find(k)][0] for k in range(len(rows))}


@pytest.mark.parametrize("found_before", [False, True])
def test_keep_one_is_complete(spark, monkeypatch, found_before):
    """every pair that meets the threshold is linked, also where balls and bands name it as no candidate."""
    if not found_before:
        monkeypatch.setattr(minhash, "candidates", lambda distinct: distinct.select("fp", "fp").toDF("a", "b").limit(0))
        monkeypatch.setattr(simhash, "links", lambda fps: fps.select("fp", "fp").toDF("a", "b").limit(0))
    rows = cousins() + [(900, None), (901, ""), (902, "a b c"), (903, "A b c"), (904, "a b c d e f g h"), (905, "a b c d e f g h i"), (906, "x x x")]
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of(rows)


def test_prefixes_share_the_first_shingle_in_common():
    """The prefixes of two sets 0.8 alike meet under any order, with frequent shingles last."""
    import numpy as np

    draw = np.random.default_rng(1)
    for _ in range(300):
        n = int(draw.integers(4, 80))
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.permutation(len(a))[: len(a) - len(a) // 10]], draw.integers(0, 2**63, len(a) // 12).astype(np.uint64)]))
        late = draw.permutation(np.unique(np.concatenate([a, b])))[: n // 2]
        place = np.argsort(late)
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            assert len(np.intersect1d(*(minhash.prefix(x, late[place], place) for x in (a, b))))


def most_mb(run):
    """What run() allocates at most at a time, numpy's arrays included, and its result."""
    tracemalloc.start()
    try:
        out = run()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_language_id_holds_little(spark):
    """F1 pipeline: texts are read in small pieces, so a worker holds some 30 MB besides its batch, and answers are those of whole batches."""
    import pandas as pd
    import pyarrow as pa

    draw = random.Random(3)
    words = {"aa": ["the", "house", "with", "green"], "bb": ["das", "haus", "gr\u00fcn", "nicht"]}
    rows = [(k, " ".join(draw.choices(words[lang], k=300)), lang) for k in range(1200) for lang in words]
    grams = pa.Table.from_batches(langid._count(iter([pa.RecordBatch.from_pydict({"lang": [r[2] for r in rows[:100]], "text": [r[1] for r in rows[:100]]})]))).to_pandas()
    model = langid.Model(grams)
    texts = [r[1] for r in rows] + [None, "", "12 34"]
    mb, found = most_mb(lambda: model.predict(texts))
    assert sum(map(len, filter(None, texts))) > 2 * 500_000 and mb < 60
    assert found["lang_pred"].tolist() == [r[2] for r in rows] + ["und"] * 3
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = langid.identify(df, model).orderBy("doc_id").select("lang_id.*").toPandas()
    assert got["cross_entropy"].isna().tolist() == [False] * len(rows) + [True] * 3
    pd.testing.assert_frame_equal(got, found)


def test_packets_hold_little():
    """F1 pipeline: a packet of variants is made and met in blocks."""
    import numpy as np
    import pyarrow as pa

    fps = np.random.default_rng(2).integers(0, 2**62, 8192).astype(np.uint64)
    fps = fps[np.bitwise_count(fps) % 2 == 0][:3000]
    fps[1::2] = fps[::2] ^ np.uint64(5)
    batch = pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])
    mb, packets = most_mb(lambda: list(simhash._emit(2)(iter([batch]))))
    assert mb < 130
    mb, met = most_mb(lambda: [simhash._meet(pa.Table.from_batches([packets[0].slice(k, 1)])) for k in range(2)])
    assert mb < 80
    got = {frozenset(p) for m in met for p in zip(m["a"].to_pylist(), m["b"].to_pylist())}
    assert {frozenset(p) for p in fps.view(np.int64).reshape(-1, 2).tolist()} <= got
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in map(tuple, got))


def test_repeated_shingles_hold_little():
    """F1 pipeline: repeats of a chunk are counted in place, and are those of a count of all."""
    import numpy as np

    draw = np.random.default_rng(4)
    for n in (0, 1, 2, 1_000_000):
        held = [draw.integers(0, 600_000, n // 4).astype(np.uint64) for _ in range(4)] + [np.arange(n % 4, dtype=np.uint64)]
        key, count = np.unique(np.concatenate(held), return_counts=True)
        mb, (found, times) = most_mb(lambda: minhash.repeated(held))
        assert (found == key[count > 1]).all() and (times == count[count > 1]).all() and not held
    assert mb < 24


def test_small_batches_end(spark):
    """F1 pipeline: batches are small while an operator runs, and the session's own setting is back after it, also after an error."""
    from quern.llm import shared

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)

    def lengths(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": [len(b)]})

    def sizes():
        return [r["id"] for r in spark.range(1200, numPartitions=1).mapInArrow(lengths, "id long").collect()]

    with pytest.raises(ValueError), shared.small_batches(spark):
        assert max(sizes()) <= shared.SLICE and sum(sizes()) == 1200
        raise ValueError
    assert spark.conf.get(key) == own and sizes() == [1200]


def joined_rows(spark, run):
    """The most rows that a join of what run() executes gave, by Spark's own counts, and run's result."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda seq: [seq.apply(k) for k in range(seq.size())]
    before = {e.executionId() for e in listed(store.executionsList())}
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = [0]
    for e in listed(store.executionsList()):
        if e.executionId() not in before:
            counts = store.executionMetrics(e.executionId())
            for node in listed(store.planGraph(e.executionId()).allNodes()):
                ids = [m.accumulatorId() for m in listed(node.metrics()) if "Join" in node.name() and m.name() == "number of output rows"]
                rows += [int(counts.apply(k).replace(",", "")) for k in ids if counts.contains(k)]
    return max(rows), out


def cloud(linked, apart, words=150, seed=9):
    """Copies of one text, each with some of its words changed: two words (near the text) and four (no longer)."""
    draw = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = [(0, " ".join(base))]
    for n, changes in ((linked, 2), (apart, 4)):
        for _ in range(n):
            made = list(base)
            for at in draw.sample(range(5, words - 5, 5), changes):
                made[at] = f"x{draw.random()}"
            rows.append((len(rows), " ".join(made)))
    return rows


def test_pairs_across_follow_the_sets(spark):
    """F1 pipeline: copies that have just left the component of their base do not meet each of its members."""
    from quern.llm.shared import components, scope, stage

    rows = cloud(160, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with scope():
        marked = stage(minhash.signatures(docs, minhash.frequent(docs)), "signatures")
        distinct = stage(marked.selectExpr("fp", "struct(doc_id is null as nameless, doc_id, text_hash) as best", "n", "bands", "prefix"), "distinct")
        base = distinct.where("best.doc_id = 0").first()["fp"]
        pairs = stage(distinct.selectExpr(f"{base}L as a", "fp as b").where("a <> b"), "pairs")
        roots = stage(components(minhash.verified(docs, distinct, pairs)), "roots")
        assert roots.count() == 160  # the root itself is not listed
        most, rest = joined_rows(spark, lambda: stage(minhash.across(distinct, roots), "rest"))
        found = {(r["a"], r["b"]) for r in minhash.verified(docs, distinct, rest).collect()}
        names = {r["doc_id"]: r["fp"] for r in marked.collect()}
    assert most <= 30 * len(rows)  # the shingles in the sets' prefixes
    sets = {names[k]: set(minhash.shingles(t).tolist()) for k, t in rows}
    away = {names[k] for k in range(161, 241)}
    assert found == {(a, b) for a in sets for b in sets if a < b and (a in away or b in away) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("hot", [2, 10**6])
def test_keep_one_is_complete_whatever_is_hot(spark, monkeypatch, hot):
    """F1 pipeline: shingles of many sets and of few find the same pairs, all of them, without any from balls and bands."""
    monkeypatch.setattr(minhash, "HOT", hot)
    monkeypatch.setattr(minhash, "candidates", lambda distinct: distinct.select("fp", "fp").toDF("a", "b").limit(0))
    monkeypatch.setattr(simhash, "links", lambda fps: fps.select("fp", "fp").toDF("a", "b").limit(0))
    rows = cousins(families=4, seed=8) + [(900 + k, t) for k, (_, t) in enumerate(cloud(20, 10))] + [(990, None), (991, ""), (992, "a b"), (993, "A b")]
    rows += [(1000 + k, " ".join(f"s{j}" for j in range(n))) for k, n in enumerate((40, 49, 50, 60, 62, 75))]  # sizes on both sides of the limit
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of(rows)
