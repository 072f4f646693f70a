"""Quality rules: counts over words and lines, and compression bands.

A text is compressed by zstandard as a whole and in fixed chunks of its UTF-8 bytes. The ratio (bytes over compressed bytes) must
lie in the band for that length: below it the text is noise (encoded data, random letters), above it says the same again and
again. Short texts cannot be compressed well, whatever they are, so bands move with the length, and below 128 bytes nothing is said. A
text is rejected if its whole ratio is outside its band, or if chunks outside theirs hold more than a quarter of its bytes: the
whole sees passages that repeat far apart, the chunks see a stretch of noise or repetition in a text that is sound on average.

Before that come base rules: too few words, or too many of them inside windows of eight words that the text has more than once.

Each row is judged alone: a narrow map. Null and empty texts have no words and fail the base rules; null ids and repeated rows pass
through, an empty table gives no rows, ties do not arise. Very long texts are split into words block by block; what is held is a number
for each word, the distinct words and lines. Other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import covered, fresh, mix, rolling

#: From so many bytes on, the least and the largest ratio. Prose has 1.3 to 1.6 at 256 bytes and 1.9 to 3 at 16,384; base64 tends to
#: 1.33 and random printable text to 1.2; source text and tables seldom pass 8.
BANDS = ((0, 0.0, float("inf")), (128, 1.05, 3.5), (256, 1.18, 4.5), (512, 1.28, 5.5), (1024, 1.40, 6.5), (4096, 1.50, 8.0), (16384, 1.60, 10.0))
#: Compression level; bytes of a chunk; a last chunk below this is not judged; share of bytes in bad chunks that is too much.
LEVEL, CHUNK, LEAST_CHUNK, BAD_SHARE = 3, 4096, 1024, 0.25
#: The base rules: words of a window, least number of words, percentage of words in repeated windows that is too much.
WINDOW, LEAST_WORDS, REPEATED = 8, 20, 30
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
#: Bytes of a text that are split into words at once.
BLOCK = 4_000_000


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def numbered(data: bytes, block: int = BLOCK) -> np.ndarray:
    """The words of a text as numbers, equal words equal."""
    ids, parts, at = _Numbers(), [], 0
    while at < len(data):
        end = at + block
        if end < len(data):  # back to the last blank, or on to the next one
            cut = max(data.rfind(c, at, end) for c in BLANKS.encode())
            if cut < 0:
                cut = min((k for c in BLANKS.encode() if (k := data.find(c, end)) >= 0), default=len(data))
            end = cut + 1
        words = data[at:end].split()
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def repeated_words(ids: np.ndarray, width: int = WINDOW, hashed=lambda ids, width: rolling(mix(ids.astype(np.uint64)), width)) -> int:
    """Words inside windows that come twice or more, the first included. Equal hashes are compared word by word."""
    h = hashed(ids, width)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return 0
    step, again = np.arange(width), np.zeros(len(h), bool)
    for a in range(0, len(same), 100_000):
        one, two = order[same[a : a + 100_000]], order[same[a : a + 100_000] + 1]
        if (ids[one[:, None] + step] != ids[two[:, None] + step]).any():  # hashes collide: by the words themselves
            first: dict = {}
            for k in range(len(h)):
                j = first.setdefault(tuple(ids[k : k + width].tolist()), k)
                again[[j, k]] |= j != k
            break
        again[one] = again[two] = True
    return int(covered(np.flatnonzero(again), width, len(ids)).sum())


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    return [(low, high) for least, low, high in bands if n_bytes >= least][-1]


def ratios(data: bytes, compress, bands=BANDS) -> tuple[float | None, int, int, bool]:
    """The whole ratio (null for no bytes), chunks judged, those outside their band, and whether the text passes."""
    if not data:
        return None, 0, 0, True
    whole = len(data) / len(compress(data))
    low, high = band(len(data), bands)
    chunks = bad = bad_bytes = 0
    for a in range(0, len(data), CHUNK):
        part = data[a : a + CHUNK]
        if len(part) < LEAST_CHUNK:
            continue
        least, most = band(len(part), bands)
        chunks += 1
        if not least <= len(part) / len(compress(part)) <= most:
            bad += 1
            bad_bytes += len(part)
    return whole, chunks, bad, low <= whole <= high and bad_bytes <= BAD_SHARE * len(data)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean"


def measures(text: str | None, compress) -> tuple:
    text = text or ""
    data = text.encode()
    ids = numbered(data)
    seen: set[bytes] = set()
    dup_lines = 0
    for line in data.split(b"\n"):
        if line.strip(BLANKS.encode()):
            dup_lines += line in seen
            seen.add(line)
    repeated = repeated_words(ids)
    failed = len(ids) < LEAST_WORDS or 100 * repeated > REPEATED * len(ids)
    ratio, chunks, bad, passes = ratios(data, compress)
    return len(ids), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup_lines, repeated, failed, ratio, chunks, bad, passes and not failed


def measured(docs: DataFrame, out: str = "measures") -> DataFrame:
    """docs with a struct of MEASURES for its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
        for batch in batches:
            found = [measures(t, compress) for t in batch.column(batch.num_columns - 1).to_pylist()]
            column = pa.array([dict(zip(names, x)) for x in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*batch.schema.names[:-1], out])

    names = [x.split()[0] for x in MEASURES.split(", ")]
    kind = pa.struct([(x.split()[0], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]]) for x in MEASURES.split(", ")])
    (text,) = fresh(docs, "text")
    with_text = docs.withColumn(text, F.col("text").cast("string"))
    schema = docs.limit(0).withColumn(out, F.lit(None).cast(f"struct<{MEASURES.replace(' ', ':')}>".replace(",:", ","))).schema
    return with_text.mapInArrow(run, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass all rules, all columns kept."""
    (found,) = fresh(docs, "measures")
    return measured(docs, found).where(F.col(found)["kept"]).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): the counts, the base verdict, the verdict of all rules, and what the bands saw."""
    return measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "measures.*")
