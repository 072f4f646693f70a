"""Queries over whole tables where no SQL can say the result: token counts by greedy search, packing against naive best fit, near
duplicates in chains and families under keys that thousands share."""

import random
from collections import Counter

import pytest

pytest.importorskip("quern.llm")
import public_tokenizers  # noqa: E402

from quern.llm import packing, simhash, wordpiece  # noqa: E402
from quern.llm.queries import QUERIES  # noqa: E402

from .test_cores import naive_best_fit  # noqa: E402
from .test_queries import check_packing  # noqa: E402


def test_token_counts_by_greedy_search(spark, sf):
    vocab = wordpiece.load_vocabulary(public_tokenizers.path(wordpiece.VOCABULARY))
    known, most, memo = set(vocab), max(map(len, vocab)), {}

    def pieces(word):
        if word not in memo:
            w, at, n = b" " + word, 0, 0
            while at < len(w):
                end = min(len(w), at + most)
                while w[at:end] not in known:
                    end -= 1
                at, n = end, n + 1
            memo[word] = n
        return memo[word]

    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        counts = [pieces(w) for w in (r["text"] or "").encode().split()]
        want[r["doc_id"], len(counts), sum(counts), max(counts, default=0)] += 1
    got = QUERIES["op10_token_counts"](spark, sf).select("doc_id", "n_words", "n_tokens", "max_word_tokens")
    assert Counter(map(tuple, got.collect())) == want
    long = "x" * 2_000_000 + " " + "ab cd " * 200_000
    one = wordpiece.count_tokens(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (one["n_words"], one["max_word_tokens"]) == (400_001, pieces(b"x" * 2_000_000)) and one["n_tokens"] == pieces(b"x" * 2_000_000) + 200_000 * (pieces(b"ab") + pieces(b"cd"))


def test_packing_is_as_tight_as_naive_best_fit(spark, sf):
    """The query itself, rounds and all: no more than one sequence in a hundred above best fit by falling length, one piece at a time."""
    rows = QUERIES["op6_best_fit_packing"](spark, sf).collect()
    check_packing(rows, packing.CAPACITY)
    used = len({r["sequence_id"] for r in rows})
    assert used <= naive_best_fit(Counter(r["length"] for r in rows), packing.CAPACITY) * 1.01 + 1
    assert used >= -(-sum(r["length"] for r in rows) // packing.CAPACITY)


def changed(draw, words, n):
    """words with n of them, far apart, replaced by new ones."""
    out = list(words)
    for at in draw.sample(range(0, len(words), 6), n):
        out[at] = f"n{draw.randrange(10**9)}"
    return out


def kept_by_all_pairs(rows):
    """Least doc_id of each component of the texts whose sets of five-word shingles are at least 0.8 alike; all pairs once."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {rows[k][0] for k in range(len(rows)) if root[k] == k}


def test_near_duplicates_in_chains_and_hot_keys(spark):
    """Chains whose ends are far apart and families over one base, so that band keys are shared by more sets than are paired with one
    another: at least nine in ten of the documents that all pairs would remove are removed, and no document that they keep is."""
    draw, rows = random.Random(12), []
    base = [f"b{draw.randrange(10**6)}" for _ in range(240)]
    for family in range(60):  # distant cousins of one base, in families of four near copies
        head = changed(draw, base, 14)
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate([head, *(changed(draw, head, 4) for _ in range(3))])]
    for chain in range(3):
        link = changed(draw, base, 20)
        for _ in range(25):
            rows.append((len(rows), " ".join(link)))
            link = changed(draw, link, 4)
    rows += [(len(rows) + k, " ".join(f"c{draw.randrange(10**6)}" for _ in range(60))) for k in range(40)]
    want = kept_by_all_pairs(rows)
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    removed, found = len(rows) - len(want), len(rows) - len(got)
    assert want <= got and found >= 0.9 * removed > 100
