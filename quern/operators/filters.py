"""Quality filters. Rules run in order and the first that fails names the reason; a null reason is a pass.

Each rule set is an ordered CASE over the features that it names, and over no others. The rules up to the first that needs sentences or
counts of words are judged first, and only texts that pass them are taken apart. No shuffle. Ratios are compared as products where
both sides are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as T
from ..functions.features import BRACKETED, DEEP, PUNCTUATION, STOP_ARCHIVE, STOP_STORY, with_features
from ..functions.names import fresh

# Fixed value: spellings of dialect.
DIALECT = (
    r"(?iU)\b(warn't|hain't|gov'ment|sivilized|hick'ry|gwyne|wuz\b|git\b|fer\b|yer\b|woulda|coulda|shoulda|gonna|wanna|"
    r"ain't gonna|hafta|gotta)\b"
)


def _over(part: str, whole: str, percent: int) -> Column:
    return F.col(part) * 100 > F.col(whole) * percent


def _mean_outside(low: float, high: float) -> Column:
    return (F.col("avg_sentence_words") < low) | (F.col("avg_sentence_words") > high)


def _first(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that holds; a rule that cannot be judged does not hold."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def book_rules(text: str = "text") -> list[tuple[str, Column]]:
    return [
        ("starts_lower", F.col("starts_lower")),
        ("quoted", _over("quoted_words", "word_count", 30)),
        ("dialect", F.col(text).rlike(DIALECT)),
        ("top_word", F.col("top_word_ratio") > 0.03),
        ("mean_sentence", _mean_outside(10, 40)),
        ("quote_chars", _over("quote_chars", "char_count", 5)),
        ("short_sentences", F.col("short_sentence_ratio") > 0.30),
        ("top10_words", F.col("top10_ratio") > 0.60),
        ("long_sentence", F.col("max_sentence_words") > 100),
    ]


def archive_rules(least_words: int = 200) -> list[tuple[str, Column]]:
    return [
        ("too_short", F.col("word_count") < least_words),
        ("starts_lower", F.col("starts_lower")),
        ("url", F.col("has_url")),
        ("digits", _over("digit_count", "char_count", 8)),
        ("upper", _over("upper_count", "alpha_count", 15)),
        ("quoted", _over("quoted_words", "word_count", 30)),
        ("mean_sentence", _mean_outside(8, 45)),
        ("short_sentences", F.col("short_sentence_ratio") > 0.30),
        ("long_sentence", F.col("max_sentence_words") > 100),
        ("repeated_start", (F.col("sentence_count") >= 4) & (F.col("top_start_ratio") > 0.40)),
        ("top_word", F.col("top_word_ratio") > 0.04),
    ]


def modern_rules(repeat: float = 0.03, least_words: int = 200) -> list[tuple[str, Column]]:
    return [
        ("too_short", F.col("word_count") < least_words),
        ("starts_lower", F.col("starts_lower")),
        ("url", F.col("has_url")),
        ("digits", _over("digit_count", "char_count", 8)),
        ("parentheses", _over("paren_chars", "char_count", 6)),
        ("upper", _over("upper_count", "alpha_count", 15)),
        ("quoted", _over("quoted_words", "word_count", 30)),
        ("quote_chars", _over("quote_chars", "char_count", 5)),
        ("mean_sentence", _mean_outside(8, 45)),
        ("short_sentences", F.col("short_sentence_ratio") > 0.30),
        ("long_sentence", F.col("max_sentence_words") > 100),
        ("repeated_start", (F.col("sentence_count") >= 4) & (F.col("top_start_ratio") > 0.40)),
        ("commas", _over("comma_count", "word_count", 12)),
        ("top_word", F.col("top_word_ratio") > repeat),
        ("top10_words", F.col("top10_ratio") > 0.60),
    ]


def abstract_rules() -> list[tuple[str, Column]]:
    return [
        ("word_count", ~F.col("word_count").between(100, 350)),
        ("symbols", _over("symbol_count", "char_count", 15)),
        ("starts_lower", F.col("starts_lower")),
        ("upper", _over("upper_count", "alpha_count", 20)),
        ("mean_sentence", _mean_outside(8, 60)),
        ("top_word", F.col("top_word_ratio") > 0.05),
    ]


def old_abstract_rules() -> list[tuple[str, Column]]:
    return [
        ("word_count", ~F.col("word_count").between(100, 350)),
        ("symbols", _over("symbol_count", "char_count", 15)),
        ("short_words", _over("short_word_count", "word_count", 25)),
    ]


def _rules(kind: str, text: str = "text", repeat: float = 0.03, least_words: int = 200) -> list[tuple[str, Column]]:
    if kind == "book":
        return book_rules(text)
    if kind == "archive":
        return archive_rules(least_words)
    if kind == "modern":
        return modern_rules(repeat, least_words)
    return {"abstract": abstract_rules, "old_abstract": old_abstract_rules}[kind]()


SETUP = {
    "book": dict(stop=STOP_STORY, split="any", punctuation=PUNCTUATION),
    "archive": dict(stop=STOP_ARCHIVE, split="capital", punctuation=BRACKETED),
    "modern": dict(stop=STOP_STORY, split="protected", punctuation=BRACKETED),
    "abstract": dict(stop=STOP_ARCHIVE, split="any", punctuation=BRACKETED, strip_stop=False),
    "old_abstract": dict(stop=STOP_ARCHIVE, split="any", punctuation=BRACKETED),
}
#: The features that a rule reads, by the rule's name.
READS = {
    "too_short": ("word_count",), "word_count": ("word_count",), "starts_lower": ("starts_lower",), "url": ("has_url",), "digits": ("digit_count", "char_count"),
    "upper": ("upper_count", "alpha_count"), "quoted": ("quoted_words", "word_count"), "dialect": (), "quote_chars": ("quote_chars", "char_count"),
    "parentheses": ("paren_chars", "char_count"), "commas": ("comma_count", "word_count"), "symbols": ("symbol_count", "char_count"),
    "short_words": ("short_word_count", "word_count"), "mean_sentence": ("avg_sentence_words",), "short_sentences": ("short_sentence_ratio",),
    "long_sentence": ("max_sentence_words",), "repeated_start": ("sentence_count", "top_start_ratio"), "top_word": ("top_word_ratio",), "top10_words": ("top10_ratio",),
}


def _needed(rules: list[tuple[str, Column]]) -> set[str]:
    return {f for name, _ in rules for f in READS[name]}


def with_reason(df: DataFrame, kind: str, text: str = "text", repeat: float = 0.03, least_words: int = 200, out: str = "reason") -> DataFrame:
    """Add the reason of a rule set: book, archive, modern, abstract or old_abstract."""
    given = [F.col(f"`{c}`") for c in df.columns]
    rules = _rules(kind, text, repeat, least_words)
    split = next((k for k, (name, _) in enumerate(rules) if set(READS[name]) & set(DEEP)), len(rules))
    early, late = rules[:split], rules[split:]
    judged = with_features(df, text, **SETUP[kind], only=_needed(early)).select(*given, _first(early).alias(out))
    if not late:
        return judged
    left = judged.withColumn("__left", F.when(F.col(out).isNull(), F.col(text)))
    made = with_features(left, "__left", **SETUP[kind], only=_needed(late))
    return made.select(*given, F.coalesce(out, F.when(F.col("__left").isNotNull(), _first(late))).alias(out))


def min_words(df: DataFrame, least: int, text: str = "text") -> DataFrame:
    return df.where(T.word_count(F.col(text)) >= least)


def drop_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without null or blank in any of the columns."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (T.strip(F.col(c).cast("string")) != ""))
    return df


def split_frame(df: DataFrame, split: str, dataset_id: str | None = None, domain: str | None = None) -> DataFrame:
    """Labelled rows of a split, by dataset and domain where given. A filter without a column is an error, and reading no rows is."""
    out = df.where((F.col("split") == split) & (F.col("label") >= 0))
    for name, value in (("dataset_id", dataset_id), ("domain", domain)):
        if value and value.strip():
            if name not in df.columns:
                raise ValueError(f"no column {name} to filter by; there are {df.columns}")
            out = out.where(F.col(name) == value.strip())
    (n,) = fresh(df, "n")
    return checks.fact(out, out.limit(1).agg(F.count("*").alias(n)), F.col(n) == 0, f"no rows for split {split}")


def training_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("split").isin("train", "val") & (F.col("label") >= 0))


def existing_files(df: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file is in a listing (path); a semi join."""
    return df.join(listing.select(F.col("path").alias(path)), path, "left_semi")


def quality_counts(df: DataFrame, kind: str, text: str = "text", **how) -> DataFrame:
    """(check, n): how many rows break each rule of a set, whatever the order; what a curated corpus should have zero of. One pass."""
    rules = _rules(kind, text, **how)
    found = with_features(df, text, **SETUP[kind], only=_needed(rules)).agg(*[F.count_if(holds).alias(name) for name, holds in rules])
    pairs = ", ".join(f"'{name}', `{name}`" for name, _ in rules)
    return found.selectExpr(f"stack({len(rules)}, {pairs}) as (check, n)")


def validate_images(df: DataFrame, content: str = "content", max_pixels: int = 89_478_485) -> DataFrame:
    """Add struct(valid, reason, width, height, warning) from the header and, for PNG, the checksums and data. An Arrow function."""
    import struct
    import zlib

    import pandas as pd

    def one(data):
        if not data:
            return (False, "empty", None, None, None)
        data = bytes(data)
        try:
            if data[:8] == b"\x89PNG\r\n\x1a\n":
                at, size, packed, ended = 8, None, [], False
                while at + 12 <= len(data) and not ended:
                    (n,) = struct.unpack_from(">I", data, at)
                    kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
                    if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
                        return (False, "checksum", None, None, None)
                    if kind == b"IHDR":
                        size = struct.unpack_from(">II", body)
                    packed += [body] if kind == b"IDAT" else []
                    ended, at = kind == b"IEND", at + 12 + n
                if size is None or not ended:
                    return (False, "truncated", None, None, None)
                unpack, rest = zlib.decompressobj(), b"".join(packed)
                while not unpack.eof:  # a piece at a time, and none is kept
                    if not unpack.decompress(rest, 1 << 20) and not unpack.unconsumed_tail and not unpack.eof:
                        return (False, "truncated", None, None, None)
                    rest = unpack.unconsumed_tail
            elif data[:6] in (b"GIF87a", b"GIF89a"):
                size = struct.unpack_from("<HH", data, 6)
            elif data[:2] == b"BM":
                size = struct.unpack_from("<ii", data, 18)
            elif data[:2] == b"\xff\xd8":
                at, size = 2, None
                while at + 9 < len(data) and data[at] == 0xFF:
                    if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                        size = struct.unpack_from(">HH", data, at + 5)[::-1]
                        break
                    at += 2 + struct.unpack_from(">H", data, at + 2)[0]
                if size is None:
                    return (False, "truncated", None, None, None)
            else:
                return (False, "format", None, None, None)
        except (struct.error, zlib.error):
            return (False, "truncated", None, None, None)
        w, h = size[0], abs(size[1])
        return (True, None, w, h, "too many pixels" if w * h > max_pixels else None)

    @F.pandas_udf("struct<valid:boolean,reason:string,width:long,height:long,warning:string>")
    def run(values):
        return pd.DataFrame([one(v) for v in values], columns=["valid", "reason", "width", "height", "warning"]).astype({"width": "Int64", "height": "Int64"})

    return df.withColumn("image", run(F.col(content)))


def decodable(df: DataFrame, content: str = "content", height: int | None = None) -> DataFrame:
    """Drop records that do not decode or do not have the asked height."""
    out = validate_images(df, content).where("image.valid")
    return out if height is None else out.where(F.col("image.height") == height)
