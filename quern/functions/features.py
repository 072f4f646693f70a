"""Text features that the quality filters share; a projection computes each of them once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Words that say nothing about a text's subject, by kind of source.
STOP_ARCHIVE = (
    "that", "with", "they", "have", "were", "would", "will", "which", "what", "their", "from", "this", "been", "there", "very",
    "into", "could", "then", "them", "him", "her", "she", "his", "you", "the", "and", "but", "for", "not", "are", "was", "had",
    "has", "its", "our", "more", "some", "when", "than", "also", "just", "like", "about", "over", "after", "before", "being",
    "other", "much", "well", "only", "even", "back", "know", "here", "time", "down", "still", "again", "never", "same", "away",
    "make", "made", "take", "took", "look", "because", "though", "without", "through", "every", "might", "must", "each", "where",
    "while", "always", "already", "between",
)
#: Stories and forums know these besides.
STOP_STORY = (
    *STOP_ARCHIVE, "said", "your", "upon", "shall", "whom", "such", "those", "these", "long", "ever", "came", "come", "went",
    "going", "looked", "tell", "told",
)
START_STOP = (
    "the", "a", "an", "in", "it", "he", "she", "this", "that", "they", "we", "i", "its", "his", "her", "their", "our", "at", "on",
    "by", "as", "of", "to", "for", "and", "but",
)
PUNCTUATION = '.,!?";:'
BRACKETED = PUNCTUATION + "()"


def _counts(df: DataFrame, items: str, out: str) -> DataFrame:
    """Counts of the sorted array's runs, as the distances between the places where a run begins."""
    s, n = F.col("__sorted"), F.size("__sorted")
    df = df.withColumn("__sorted", F.sort_array(items))
    df = df.withColumn("__begin", F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)")), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2))))
    begin = F.col("__begin")
    counts = F.transform(begin, lambda b, k: F.coalesce(F.get(begin, k + 1), n + 1) - b)
    return df.withColumn(out, F.sort_array(counts, asc=False)).drop("__sorted", "__begin")


#: Features that take a look at the characters only, and those that need sentences or counts of words.
PLAIN = (
    "char_count", "digit_count", "upper_count", "alpha_count", "symbol_count", "quote_chars", "paren_chars", "comma_count", "starts_lower", "has_url",
    "words", "word_count", "short_word_count", "quoted_words",
)
DEEP = ("sentences", "sentence_count", "avg_sentence_words", "short_sentence_ratio", "max_sentence_words", "top_word_ratio", "top10_ratio", "top_start_ratio")
_SENTENCES = {"sentence_count", "avg_sentence_words", "short_sentence_ratio", "max_sentence_words", "top_start_ratio", "sentences"}
_CONTENT = {"top_word_ratio", "top10_ratio"}


def with_features(df: DataFrame, text: str = "text", stop=STOP_STORY, split: str = "capital", punctuation: str = BRACKETED, strip_stop: bool = True, only=None) -> DataFrame:
    """Add the features named in `only` (all of PLAIN and DEEP without it) as columns. split: any, capital or protected sentences.
    strip_stop=False tests stop words before punctuation is stripped."""
    t, given = F.col(text), df.columns
    names = [*PLAIN, *DEEP] if only is None else [n for n in (*PLAIN, *DEEP) if n in only]
    if only is not None and (odd := set(only) - set(names)):
        raise ValueError(f"no features {sorted(odd)}")
    use = set(names)
    parts = {"any": lambda c: F.filter(T.sentences_any(c), lambda s: T.strip(s) != ""), "capital": T.sentences_capital, "protected": T.sentences_protected}[split]
    first = {
        "words": T.words(t),
        "sentences": parts(t),
        "char_count": F.length(t),
        "digit_count": F.length(F.regexp_replace(t, r"[^\p{Nd}\x{B2}\x{B3}\x{B9}]+", "")),
        "upper_count": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
        "alpha_count": F.length(F.regexp_replace(t, r"\P{L}+", "")),
        "symbol_count": F.length(F.regexp_replace(t, r"(?U)[\p{L}\s\x1c-\x1f]+", "")),
        "quote_chars": F.length(F.regexp_replace(t, '[^"]+', "")),
        "paren_chars": F.length(F.regexp_replace(t, "[^()]+", "")),
        "comma_count": F.length(F.regexp_replace(t, "[^,]+", "")),
        "quoted": F.regexp_extract_all(t, F.lit('"([^"]*)"'), F.lit(1)),
        "starts_lower": F.coalesce(t.rlike(r"^\p{Ll}"), F.lit(False)),
        "has_url": F.coalesce(t.rlike("https?://"), F.lit(False)),
    }
    made = set(use)
    made |= {"words"} if use & {"word_count", "short_word_count", *_CONTENT} else set()
    made |= {"quoted"} if "quoted_words" in use else set()
    made |= {"sentences"} if use & _SENTENCES else set()
    df = df.withColumns({k: v for k, v in first.items() if k in made})
    strip = lambda w: F.btrim(F.lower(w), F.lit(punctuation))
    second = {}
    if "sentences" in made:
        second["sentence_words"] = F.transform("sentences", T.word_count)
    if use & _CONTENT:
        long = F.filter("words", lambda w: F.length(w) > 3)
        second["content"] = F.filter(F.transform(long, strip), lambda w: ~w.isin(*stop)) if strip_stop else F.transform(F.filter(long, lambda w: ~F.lower(w).isin(*stop)), strip)
    if "top_start_ratio" in use:
        second["starts"] = F.filter(F.transform("sentences", lambda s: F.lower(F.regexp_extract(s, r"(?U)[^\s\x1c-\x1f]+", 0))), lambda s: ~s.isin(*START_STOP))
    df = df.withColumns(second) if second else df
    for items in ("content", "starts"):
        df = _counts(df, items, f"{items}_counts") if items in second else df
    n = F.size("sentences")
    ratio = lambda a, b: F.when(b > 0, a / b)
    last = {
        "word_count": lambda: F.size("words"),
        "quoted_words": lambda: F.aggregate("quoted", F.lit(0), lambda a, q: a + T.word_count(q)),
        "sentence_count": lambda: n,
        "avg_sentence_words": lambda: ratio(F.aggregate("sentence_words", F.lit(0), lambda a, x: a + x), n),
        "short_sentence_ratio": lambda: ratio(F.size(F.filter("sentence_words", lambda x: x <= 3)), n),
        "max_sentence_words": lambda: F.coalesce(F.array_max("sentence_words"), F.lit(0)),
        "top_word_ratio": lambda: ratio(F.get("content_counts", F.lit(0)), F.size("content")),
        "top10_ratio": lambda: ratio(F.aggregate(F.slice("content_counts", 1, 10), F.lit(0), lambda a, x: a + x), F.size("content")),
        "top_start_ratio": lambda: ratio(F.get("starts_counts", F.lit(0)), n),
        "short_word_count": lambda: F.size(F.filter("words", lambda w: F.length(w) <= 2)),
    }
    # One generated row holds all features: a filter on them stops there, where a plain projection would have it repeat the
    # features' whole expressions for every use.
    return df.select(*[F.col(f"`{c}`") for c in given], F.inline(F.array(F.struct(*[last[k]().alias(k) if k in last else F.col(k) for k in names]))))
