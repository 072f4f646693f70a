"""Sources of labelled texts: what their columns are called, and how they become one corpus of (text, is_generated, ...)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import map_normalized, map_value
from ..operators import chunk, dedup, profile, splits

LEAST_WORDS = 10


@dataclass(frozen=True)
class Adapter:
    """The text's and the label's column, and how labels become 0 and 1: as numbers (no names), by exact names, or by names after
    trimming and in lower case. answers: the columns of JSON lists of human and of generated answers instead."""

    text: str = "text"
    label: str = "label"
    names: Mapping[str, int] = field(default_factory=dict)
    exact: bool = False
    answers: tuple[str, str] | None = None


SIDES = {"human": 0, "ai": 1}
#: The shapes that known sources have.
SHAPES = {
    "capital_text": Adapter("Text", "generated"),
    "generated": Adapter("text", "generated"),
    "students": Adapter("Text", "Label", {"student": 0, "ai": 1}, exact=True),
    "named_or_numbered": Adapter("text", "label", {**SIDES, "0": 0, "1": 1}),
    "numbered": Adapter("text", "label"),
    "authors": Adapter("content_text", "author_type", SIDES),
    "canonical": Adapter("text", "isGenerated"),
    "by_source": Adapter("text", "source", SIDES),
    "answers": Adapter(answers=("human_answers", "chatgpt_answers")),
}


def canonical(df: DataFrame, adapter: Adapter) -> DataFrame:
    """(text, is_generated) as the source has them: names that are not known are null."""
    if adapter.answers:
        return chunk.explode_answers(df, *adapter.answers)
    label = F.col(f"`{adapter.label}`")
    if not adapter.names:
        value = label.try_cast("double").cast("int")
    else:
        value = map_value(label.cast("string"), adapter.names) if adapter.exact else map_normalized(label, adapter.names)
    return df.select(F.col(f"`{adapter.text}`").cast("string").alias("text"), value.alias("is_generated"))


def clean(df: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Equal rows once, rows with a null dropped, leak labels out, white space squeezed, short texts dropped."""
    rows = df.select("text", "is_generated").where("text is not null and is_generated is not null").dropDuplicates(["text", "is_generated"])
    return rows.withColumn("text", T.squeeze(T.strip_leak_labels(F.col("text")))).where(T.word_count(F.col("text")) >= least_words)


def clean_synthetic(df: DataFrame, least_words: int = 50) -> DataFrame:
    """A generator's texts, all columns kept: markdown, what it says about itself, filler openings and leak labels out, white space
    squeezed, blank and short texts dropped."""
    steps = (T.remove_markdown, T.remove_meta, T.remove_filler, T.strip_leak_labels, T.squeeze)
    out = df.where(F.col("text").isNotNull()).withColumn("text", reduce(lambda c, step: step(c), steps, F.col("text")))
    return out.where((F.col("text") != "") & (T.word_count(F.col("text")) >= least_words))


def combine_human(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(text, is_generated) of the parts that there are, the first of equal texts, by the parts' order."""
    tagged = [d.select("text", "is_generated", F.lit(k).alias("__o")) for k, d in enumerate(parts.values())]
    return dedup.dedup_first(dedup.union_all(*tagged), ["text"], "__o").select("text", "is_generated")


def check(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, null or blank texts, repeated texts, the labels and the words."""
    w = T.word_count(F.col("text"))
    return df.select("text", "is_generated", w.alias("w")).agg(
        F.lit(name).alias("part"), F.count("*").alias("rows"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"),
        (F.count("*") - F.count_distinct(F.struct(F.xxhash64("text")))).alias("repeated"), F.array_sort(F.collect_set("is_generated")).alias("labels"),
        F.min("w").alias("min_words"), F.max("w").alias("max_words"), F.round(F.avg("w"), 6).alias("mean_words"),
    )


def merge(human: DataFrame, synthetic: DataFrame, key: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The corpus of both classes in a seeded order, and a report: checks of both parts with the texts that both have. Texts of both
    classes are counted and not removed. key orders rows of one text; without it they follow their label."""
    both = dedup.union_all(human, synthetic).withColumn("is_generated", F.col("is_generated").cast("int"))
    shared = dedup.shared_texts(human, synthetic).agg(F.count("*").alias("in_both"))
    report = check(human, "human").unionByName(check(synthetic, "synthetic")).crossJoin(shared)
    return both.orderBy(splits.shuffle_key("text", seed), "text", key or "is_generated"), report


def shares(corpus: DataFrame) -> DataFrame:
    return profile.class_shares(corpus, "is_generated")
