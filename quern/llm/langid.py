"""Language ID by interpolated Kneser-Ney character models.

Texts are read as letters in lower case, with every run of other characters as one blank. Per language, an order-4 model
with absolute discounts n1 / (n1 + 2 n2) and continuation counts below the top is learned from a bounded sample of
labelled rows. All languages share, for each order, one sorted array of n-gram hashes with the log probability of each
n-gram in every language, worked out at training even where a language never saw it, and one of contexts with their
back-off weights; a missing n-gram costs its context's weight and is looked up one order lower. The language with the least
cross-entropy per character wins.

Rejection is calibrated on the half of the sample that the counts leave out. A text's distance is that of its cross-entropy from
its language's median there, in robust deviations (from the median distance, so that odd rows do not widen them), which shrink as texts
grow. A language's limit is MARGIN times the distance that at most RATE of its clean texts exceed, with 95 % confidence
in that number (an order statistic), or FLOOR, whichever is more. A language with too few texts left out for such a statement takes the
one of all languages together, FLOOR where they are too few as well; with fewer than LEAST it takes the median centre and deviation of the others.
Where no language has as many, nothing is rejected but texts without a letter.

The sample is bounded: SAMPLE_ROWS rows a language, of the LANGUAGES languages with the most rows (of as many, the first by name).
Only counts of n-grams, which follow from that, and a few numbers for each row left out reach the driver. Learning and predictions
read whole texts, a long one in pieces of CHUNK characters that carry their context on, so a task holds a piece at a time.

Null texts and texts without a letter are `und`, rejected, score 0. Without any labelled row everything is `und`. Null
langs are not learned from; rows with a null doc_id neither, and count as not held out. Of languages at the same
cross-entropy the first by name wins. Repeated rows pass through, an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, mix, rolling, slices, small_batches

ORDER = 4
#: Labelled rows of each language in the sample: those with the least hash of id and text, equal rows once. One in CALIBRATE is left out of the counts.
SAMPLE_ROWS = 1000
CALIBRATE = 2
OVERSAMPLE = 1.5
#: Languages that one model has, those with the most labelled rows.
LANGUAGES = 1000
#: Texts left out that a centre and a deviation of a language's own take.
LEAST = 20
#: The share of clean texts that may lie beyond the distance that MARGIN multiplies; the least limit; the least deviation, in nats.
RATE, MARGIN, FLOOR, LEAST_DEVIATION = 0.05, 5.0, 25.0, 0.02
#: Characters read at once; what is made of each takes some 300 bytes.
CHUNK = 100_000
#: Cross-entropy in nats to log odds, for the score.
SHARPNESS = 12.0

_lut: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank."""
    global _lut
    if _lut is None:
        _lut = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            if (s := chr(c)).isalpha():
                _lut[c] = ord(s.lower()[0])
    return _lut


def read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of letters and blanks, ORDER - 1 blanks before each and one behind; each one's place and length."""
    raw = [(t or "").encode("utf-32-le", "replace") for t in texts]
    x = _letters()[np.frombuffer(b"".join(raw), np.uint32)]
    doc = np.repeat(np.arange(len(raw)), [len(r) // 4 for r in raw])
    keep = x != 32
    keep[1:] |= (x[:-1] != 32) & (doc[1:] == doc[:-1])  # the first blank of a run behind a letter
    x, doc = x[keep], doc[keep]
    sizes = np.bincount(doc, minlength=len(raw)).astype(np.int64)
    out = np.full(int(sizes.sum()) + ORDER * len(raw), 32, np.uint32)
    out[np.arange(len(x)) + ORDER * doc + ORDER - 1] = x
    return out, np.cumsum(sizes + ORDER) - (sizes + ORDER), sizes


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, windows, spans): the windows of ORDER letters of texts[a:b] as rows, one for each letter or blank and one for the blank
    behind, and how many each text has; texts without a letter have none. Of a text longer than CHUNK characters several pieces come, a = b - 1."""
    rows = lambda x: np.lib.stride_tricks.sliding_window_view(x, ORDER)
    a = 0
    while a < len(texts):
        b, chars = a, 0
        while b < len(texts) and (b == a or chars + len(texts[b] or "") <= CHUNK):
            chars += len(texts[b] or "")
            b += 1
        if chars <= CHUNK:
            x, first, sizes = read(texts[a:b])
            spans = np.where(sizes > 0, sizes + 1, 0)
            starts = np.arange(int(spans.sum())) + np.repeat(first - (np.cumsum(spans) - spans), spans)
            if len(starts):
                yield a, b, x[starts[:, None] + np.arange(ORDER)], spans
        else:
            before, letter, any_ = np.full(ORDER - 1, 32, np.uint32), False, False
            for k in range(0, chars, CHUNK):
                x = _letters()[np.frombuffer(texts[a][k : k + CHUNK].encode("utf-32-le", "replace"), np.uint32)]
                keep = x != 32
                keep[1:] |= x[:-1] != 32
                keep[0] |= letter
                letter = bool(x[-1] != 32)
                line = np.concatenate([before, x[keep]])
                if len(line) >= ORDER:
                    any_ = True
                    yield a, b, rows(line), np.array([len(line) - ORDER + 1])
                before = line[len(line) - ORDER + 1 :]
            if any_:
                yield a, b, np.append(before, np.uint32(32))[None, :], np.array([1])
        a = b


def _hash(codes: np.ndarray, k: int) -> np.ndarray:
    return mix(rolling(mix(codes.astype(np.uint64), 11), k), k)


def _hash_rows(grams: np.ndarray) -> np.ndarray:
    """Hashes of the rows of an n x k array of code points."""
    k = grams.shape[1]
    return _hash(grams.ravel(), k)[::k] if len(grams) else np.zeros(0, np.uint64)


class Model:
    """names; by order k: hashes[k], logp[k]; contexts of k letters: ctx[k], weight[k]; unseen: log probability of a new letter;
    mean, deviation, limit: of the calibration, by language."""

    def __init__(self, counts: pd.DataFrame):
        """counts: lang, gram (a string of ORDER letters), n."""
        self.names = sorted(counts["lang"].unique())
        size = len(self.names)
        self.mean, self.deviation, self.limit = np.zeros(size), np.ones(size), np.full(size, np.inf)
        if not size:
            return
        self.hashes, self.logp, self.ctx, self.weight = {}, {}, {}, {}
        # by order and language: distinct n-grams as rows of code points, and their counts; below the top a count is that of
        # the distinct longer n-grams that end in it
        tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in range(1, ORDER + 1)}
        for name in self.names:
            part = counts[counts["lang"] == name].groupby("gram", sort=False)["n"].sum()
            grams = np.frombuffer("".join(part.index).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
            n = part.to_numpy(np.float64)
            for k in range(ORDER, 0, -1):
                tables[k].append((grams, n))
                _, first, n = np.unique(_hash_rows(np.ascontiguousarray(grams[:, 1:])), return_index=True, return_counts=True) if k > 1 else (None, None, None)
                grams, n = (grams[first, 1:], n.astype(np.float64)) if k > 1 else (None, None)
        letters = len(np.unique(np.concatenate([g[:, 0] for g, _ in tables[1]]))) + 1
        lower_hashes, lower = None, np.full((1, size), 1 / letters)
        for k in range(1, ORDER + 1):
            every = np.concatenate([g for g, _ in tables[k]])
            hashes, first = np.unique(_hash_rows(every), return_index=True)
            grams = every[first]
            at = np.searchsorted(lower_hashes, _hash_rows(np.ascontiguousarray(grams[:, 1:]))) if k > 1 else np.zeros(len(grams), np.int64)
            prob = lower[at]
            head_of = _hash_rows(np.ascontiguousarray(grams[:, :-1])) if k > 1 else np.zeros(len(grams), np.uint64)
            heads, head_of = np.unique(head_of, return_inverse=True)
            weight = np.ones((len(heads), size))
            for j, (own, c) in enumerate(tables[k]):
                n1, n2 = int((c == 1).sum()), int((c == 2).sum())
                cut = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                mine = np.searchsorted(hashes, _hash_rows(own))
                total, kinds = np.bincount(head_of[mine], c, len(heads)), np.bincount(head_of[mine], minlength=len(heads))
                there = kinds > 0
                weight[there, j] = cut * kinds[there] / total[there]
                prob[:, j] *= weight[head_of, j]
                prob[mine, j] += np.maximum(c - cut, 0) / total[head_of[mine]]
            lower_hashes, lower = hashes, prob
            self.hashes[k], self.logp[k] = hashes, np.log(prob)
            if k > 1:
                self.ctx[k - 1], self.weight[k - 1] = heads, np.log(weight)
            else:
                self.unseen = np.log(weight[0] / letters)

    def _look(self, grams: np.ndarray) -> np.ndarray:
        """Log probabilities of the last letter of each row, in every language."""
        k = grams.shape[1]
        if k == 0:
            return np.tile(self.unseen, (len(grams), 1))
        h = _hash_rows(grams)
        at = np.minimum(np.searchsorted(self.hashes[k], h), len(self.hashes[k]) - 1)
        out = self.logp[k][at]
        miss = self.hashes[k][at] != h
        if miss.any():
            lower = self._look(grams[miss][:, 1:])
            if k > 1:
                h = _hash_rows(np.ascontiguousarray(grams[miss][:, :-1]))
                at = np.minimum(np.searchsorted(self.ctx[k - 1], h), len(self.ctx[k - 1]) - 1)
                lower = lower + np.where((self.ctx[k - 1][at] == h)[:, None], self.weight[k - 1][at], 0.0)
            out[miss] = lower
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: cross-entropy per character in every language, and the characters (0: no letter)."""
        size = len(texts)
        if len(self.names) == 0:
            return np.zeros((size, 0)), np.zeros(size, np.int64)
        ce, n = np.zeros((size, len(self.names))), np.zeros(size, np.int64)
        for a, b, windows, spans in pieces(texts):
            which, kinds = pd.factorize(_hash_rows(windows))
            sample = np.empty(len(kinds), np.int64)
            sample[which] = np.arange(len(windows))
            logs = self._look(windows[sample])
            some = np.flatnonzero(spans)
            ce[a + some] -= np.add.reduceat(logs[which], (np.cumsum(spans) - spans)[some])
            n[a:b] += spans
        ce[n > 0] /= n[n > 0, None]
        return ce, np.maximum(n - 1, 0)

    def own_entropies(self, texts: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its language's number (-1: not learned), its cross-entropy there, and the characters."""
        ce, n = self.entropies(texts)
        own = np.array([self.names.index(x) if x in self.names else -1 for x in langs], np.int64)
        return own, ce[np.arange(len(own)), np.maximum(own, 0)], n

    def calibrate(self, own: np.ndarray, own_ce: np.ndarray, n: np.ndarray) -> None:
        ok = (own >= 0) & (n > 0)
        own, own_ce, n = own[ok], own_ce[ok], n[ok]
        sizes = np.bincount(own, minlength=len(self.names))
        sure = np.flatnonzero(sizes >= LEAST)
        if not len(sure):
            return
        for j in sure:
            at = own == j
            self.mean[j] = np.median(own_ce[at])
            # a text's own spread plus that of its length; 1.4826 makes a median distance a deviation
            self.deviation[j] = max(LEAST_DEVIATION, 1.4826 * np.median(np.abs(own_ce[at] - self.mean[j]) / np.sqrt(self._widen(n[at]))))
        others = sizes < LEAST
        self.mean[others], self.deviation[others] = np.median(self.mean[sure]), np.median(self.deviation[sure])
        far = self.distance(own, own_ce, n)
        together = far_quantile(far[sizes[own] >= LEAST])
        own_bounds = [far_quantile(far[own == j]) for j in range(len(self.names))]
        self.limit = np.array([max(FLOOR, MARGIN * (x if x is not None else together if together is not None else 0)) for x in own_bounds])

    def distance(self, own: np.ndarray, ce: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of cross-entropies in languages from these languages' centres, in deviations at the texts' lengths."""
        return (ce - self.mean[own]) / (self.deviation[own] * np.sqrt(self._widen(n)))

    @staticmethod
    def _widen(n: np.ndarray) -> np.ndarray:
        return 1 + 400 / np.maximum(n, 1)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        ce, n = self.entropies(texts)
        if not self.names:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "cross_entropy": np.nan, "rejected": True})
        best = ce.argmin(axis=1)
        least = ce[np.arange(len(best)), best]
        score = 1 / np.exp(-SHARPNESS * (ce - least[:, None])).sum(axis=1)
        far = self.distance(best, least, n)
        none = n == 0
        return pd.DataFrame({
            "lang_pred": np.where(none, "und", np.array(self.names, object)[best]),
            "score": np.where(none, 0.0, score),
            "cross_entropy": np.where(none, np.nan, least),
            "rejected": none | (far > self.limit[best]),
        })


def far_quantile(far: np.ndarray, rate: float = RATE) -> float | None:
    """A number that at most `rate` of such distances exceed, with 95 % confidence: the order statistic whose rank lies 1.645 deviations of a
    binomial count above the quantile's. None where so many numbers cannot say it."""
    n = len(far)
    rank = math.ceil(n * (1 - rate) + 1.645 * math.sqrt(n * rate * (1 - rate)) + 1)
    return float(np.sort(far)[rank - 1]) if rank <= n else None


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from (doc_id, text, lang) of rows that are not held out: sample_rows of each language, whatever the table's size.

    The sample's bound in hash is found per language first, from counts; then the sampled texts' n-grams are counted, and the
    texts left out scored, where they are.
    """
    nothing = Model(pd.DataFrame({"lang": [], "gram": [], "n": []}))
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(5)).alias("h"), F.col("text").cast("string").alias("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()  # a row per language
    if not counts:
        return nothing
    # Hashes are uniform: this share of their range holds about OVERSAMPLE times the rows wanted, so the exact bound is
    # looked for among few rows, whatever the size of a language.
    share = {r["lang"]: min(1.0, OVERSAMPLE * sample_rows / r["n"]) for r in counts}
    of = lambda values: F.create_map(*[x for lang, v in values.items() for x in (F.lit(lang), F.lit(v))])[F.col("lang")]
    order = Window.partitionBy("lang").orderBy("h")
    few = rows.select("lang", "h").where(F.col("h") <= of({lang: min(int(f * 2**64) - 2**63, 2**63 - 1) for lang, f in share.items()})).distinct()
    bounds = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_rows).groupBy("lang").agg(F.max("h").alias("most"), F.count("*").alias("n")).collect()
    if not bounds:
        return nothing
    sample = rows.where(F.col("h") <= of({r["lang"]: r["most"] for r in bounds})).dropDuplicates(["lang", "h"])
    spare = {r["lang"]: r["n"] >= 2 * CALIBRATE for r in bounds}
    aside = of(spare) & (F.pmod(F.xxhash64("h"), F.lit(CALIBRATE)) == 0)
    grams = (
        sample.where(~aside).select("lang", "text").mapInArrow(_count, "lang string, gram string, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    )
    if not len(grams):
        return nothing
    model = Model(grams)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = held.value.own_entropies(part.column("text").to_pylist(), part.column("lang").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["own", "ce", "n"])

    left = sample.where(aside).select("lang", "text").mapInArrow(score, "own long, ce double, n long").toPandas()
    if len(left):
        model.calibrate(*(left[c].to_numpy() for c in ("own", "ce", "n")))
    held.destroy()
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = batch.to_pandas()
        for lang, part in t.groupby("lang"):
            for _, _, windows, _ in pieces(part["text"].tolist()):
                grams, n = np.unique(windows, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(["".join(map(chr, g)) for g in grams.tolist()], pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


FOUND = "struct<lang_pred:string,score:double,cross_entropy:double,rejected:boolean>"
_FOUND = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])


def identify(docs: DataFrame, model: Model, out: str = "lang_id") -> DataFrame:
    """Add a struct (lang_pred, score, cross_entropy, rejected) of each whole text. A narrow map; the model's size is bounded."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        found = [pa.RecordBatch.from_pandas(held.value.predict(part.to_pylist()), _FOUND, preserve_index=False).to_struct_array() for part in slices(texts)]
        return pa.concat_arrays(found) if found else pa.array([], pa.struct(list(_FOUND)))

    return docs.withColumn(out, run(F.col("text").cast("string")))


def digest(docs: DataFrame, model: Model) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return identify(slim, model, "_f").select("doc_id", "held_out", "_f.lang_pred", "_f.score", "_f.cross_entropy", "_f.rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without those that are rejected, all columns kept; learned from docs' own labelled rows."""
    (out,) = fresh(docs, "lang_id")
    with small_batches(docs.sparkSession):
        model = train(docs)
    return identify(docs, model, out).where(~F.col(f"{out}.rejected")).drop(out)
