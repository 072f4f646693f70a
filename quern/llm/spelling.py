"""Spelling variant grouping: words one edit apart, by a self-join of the vocabulary's trie with active-node sets.

The vocabulary is cut into small tries by what words share. Two words one edit apart differ in one slot, the length of their common
prefix: they agree on all letters before it and behind it. A window is a range of slots; words go to the trie of each window by the
prefix before it and the suffix behind it, so a pair meets in the window that holds its slot, and only there is it reported. At
first the windows are the two halves of a word: a prefix-partitioned trie of word ends, and one of word begins. A trie that would
hold more than LETTERS letters is parted again: its words go to the two halves of its window, until a window is one slot, where
the alphabet bounds a trie. So hot prefixes are split and no pair is lost.

In a trie each node has the set of nodes at distance one, its active nodes. It is propagated from parent to child: a child's
active nodes are the parent, the siblings, its own children, and what the child's letter leads to from the parent's active nodes.
Where a word ends at a node and another at an active node, that is a pair.

Words are the runs of `[A-Za-z\\u00C0-\\u00FF]` of whole texts, A-Z lowered. In a row, one run in 31 (by crc32 of id and run) loses
a letter: the noise that the digest asks for; `noise=None` leaves it out. Null texts have no words, a null id is written as the
empty string, repeated rows count as often as they come, ties of frequency go to the least word, an empty table gives no rows. Very
long texts are one row's distinct runs, very long words are cut to windows like all others. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, scope, stage

#: One run in so many loses a letter; the fewest letters and occurrences of a word; how much more frequent a form is.
NOISE, LEAST_LETTERS, LEAST_COUNT, FACTOR = 31, 7, 2, 10
#: Letters in one trie, beyond which its window is halved. A window of one slot has at most 90 words of one letter and 8,100 of two.
LETTERS = 100_000
#: Distinct words whose counts a task holds before it hands them on.
HELD = 500_000

COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def count_words(docs: DataFrame, noise: int | None = NOISE, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over all rows of docs (doc_id, text); counts are summed within a task before they are shuffled."""
    # texts are read as Latin-1, where a letter is a byte and lower() touches A-Z only; any other character parts runs
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least_letters)

    def words(doc_id: int | None, text: str) -> Iterator[tuple[bytes, int]]:
        seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for run, n in Counter(runs.findall(text.encode("latin-1", "replace").lower())).items():
            if noise:
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                if h % noise == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < least_letters:
                        continue
            yield run, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], schema=COUNTS)

        for batch in batches:
            for doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(2))):
                for word, n in words(doc_id, text):
                    held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# Words in windows: base is the length of the shorter word of a pair, over says whether this is the longer; slots [s, e) of 0..base.

_WINDOW = ["base", "s", "e"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Add the key that the words of one trie share: what comes before the window and behind it."""
    return rows.withColumn("key", F.expr("xxhash64(base, s, e, substring(word, 1, s), substring(word, e + over + 1))"))


def _halves(words: DataFrame) -> DataFrame:
    """Each word with the halves of its slots, as the shorter and as the longer of a pair."""
    return _keyed(
        words.selectExpr("word", "n", "char_length(word) as size")
        .selectExpr("word", "n", "size", "explode(array(0, 1)) as over")
        .selectExpr("word", "n", "over", "size - over as base")
        .where("base > 0")
        .selectExpr("word", "n", "over", "base", "inline(array(struct(0 as s, (base + 1) div 2 as e), struct((base + 1) div 2 as s, base + 1 as e)))")
        .selectExpr("word", "n", "over", "base", "cast(s as int) as s", "cast(e as int) as e")
    )


def _parted(rows: DataFrame, letters: int, salts: int = 64) -> Iterator[DataFrame]:
    """The rows of _halves in windows whose tries stay below the bound; yields parts whose windows differ."""
    while True:
        size = rows.groupBy("key", *_WINDOW).agg(F.count("*").alias("m"))
        hot = stage(size.where((F.col("m") > 1) & (F.col("m") * (F.col("e") - F.col("s") + 1) > letters) & (F.col("e") - F.col("s") > 1)).select("key", *_WINDOW), "spelling_hot")
        if hot.isEmpty():
            drop(hot)
            yield rows
            return
        # a hot key's words are dealt over salts, so that no task meets them all
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int"))
        every = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = ["key", *_WINDOW, "salt"]
        yield dealt.join(every, on, "left_anti").drop("salt")
        rows = _keyed(
            dealt.join(every, on, "left_semi")
            .selectExpr("word", "n", "over", "base", "inline(array(struct(s as s, (s + e) div 2 as e), struct((s + e) div 2 as s, e as e)))")
            .selectExpr("word", "n", "over", "base", "cast(s as int) as s", "cast(e as int) as e")
        )


class Trie:
    """Words' parts as nodes; node 0 is the root."""

    def __init__(self, parts: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, list[int]] = {}
        for k, part in enumerate(parts):
            at = 0
            for letter in part:
                to = self.children[at].get(letter)
                if to is None:
                    to = self.children[at][letter] = len(self.children)
                    self.children.append({})
                at = to
            self.ends.setdefault(at, []).append(k)

    def pairs(self) -> Iterator[tuple[int, int]]:
        """(a, b) and (b, a) for the parts at distance one, by active nodes from parent to child."""
        children, ends = self.children, self.ends
        todo = [(0, set(children[0].values()))]
        while todo:
            node, active = todo.pop()
            if node in ends:
                for other in active:
                    if other in ends:
                        for a in ends[node]:
                            for b in ends[other]:
                                yield a, b
            below = children[node]
            for letter, child in below.items():
                reached = {children[v][letter] for v in active if letter in children[v]}
                reached.add(node)
                reached.update(below.values())
                reached.update(children[child].values())
                reached.discard(child)
                todo.append((child, reached))


def slot(a: str, b: str) -> int | None:
    """Where a and b differ if they are one edit apart, else None."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return None
    low, high = 0, len(a)  # the common prefix by bisection, as words can be long
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low if a[low + (len(a) == len(b)) :] == b[low + 1 :] else None


LINKS = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A trie a row (base, s, e, members): both directions of its pairs. Hashed keys may bring strangers together, so pairs are looked at."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for base, s, e, members in zip(*(batch.column(k).to_pylist() for k in range(4))):
            words = [m["word"] for m in members]
            for a, b in Trie([w[s : e + len(w) - base] for w in words]).pairs():
                one, two = words[a], words[b]
                if min(len(one), len(two)) == base and (at := slot(one, two)) is not None and s <= at < e:
                    out[0].append(one)
                    out[1].append(two)
                    out[2].append(members[b]["n"])
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, LINKS)], schema=LINKS)


def near_words(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(word, other, other_n): every ordered pair of words (word, n) at edit distance one, once."""
    parts = None
    for rows in _parted(_halves(words), letters):
        parts = rows if parts is None else parts.unionByName(rows)
    tries = parts.groupBy("key", *_WINDOW).agg(F.collect_list(F.struct("word", "n")).alias("members")).where(F.size("members") > 1)
    return tries.select(*_WINDOW, "members").mapInArrow(_joined, "word string, other string, other_n long")


def variants(words: DataFrame, factor: int = FACTOR, letters: int = LETTERS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of the words (word, n): the near word of largest n where that is at least
    factor times the word's own, and the word that forms lead to in the end."""
    with scope() as keep:
        words = stage(words, "spelling_words")
        one = words.selectExpr("word", "n", "cast(null as string) as other", "cast(null as bigint) as other_n")
        two = near_words(words, letters).selectExpr("word", "cast(null as bigint) as n", "other", "other_n")
        met = one.unionByName(two).groupBy("word").agg(
            F.max("n").alias("n"), F.count("other").alias("n_near"),
            F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))).alias("best"),
        )
        good = -F.col("best.less") >= factor * F.col("n")
        found = keep(stage(met.select("word", F.when(good, F.col("best.other")).alias("form"), "n", "n_near", F.when(good, -F.col("best.less")).alias("form_n")), "spelling"))
        roots = keep(_roots(found.where("form is not null").select("word", F.col("form").alias("root"))))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root) with steps (word, root) followed to the last. n grows from form to form by the factor, so chains are short, and
    each round doubles what it follows."""
    now = stage(steps, "spelling_roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        new = stage(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "spelling_roots")
        drop(now)
        if new.where("moved").isEmpty():
            return new
        now = new


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of all words of docs (doc_id, text)."""
    return variants(count_words(docs))
