"""Labels, verdicts and other scalar decisions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_value(c: Column, values: Mapping[str, int]) -> Column:
    """The mapped value, null where there is none. Case-sensitive."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def map_normalized(c: Column, values: Mapping[str, int]) -> Column:
    """As map_value, over the trimmed lower-case text of any column."""
    return map_value(F.lower(F.trim(c.cast("string"))), values)


def binary_labels(df: DataFrame, label: str, out: str = "y") -> DataFrame:
    """0/1 labels. Numeric if every value parses and they are exactly 0 and 1; else two distinct names: human is 0 and ai is 1,
    or alphabetical order. One aggregate checks; more or fewer than two names raise."""
    name = F.lower(F.trim(F.col(label).cast("string")))
    number = F.expr(f"try_cast(`{label}` as double)")
    said = df.agg(
        F.bool_and(number.isNotNull()).alias("numeric"),
        F.bool_and(F.coalesce(number.isin(0.0, 1.0), F.lit(False))).alias("binary"),
        F.count_distinct(number).alias("values"),
        F.count_distinct(name).alias("names"),
        F.min(name).alias("low"),
        F.max(name).alias("high"),
    ).first()
    if said["numeric"] and said["binary"] and said["values"] == 2:
        return df.withColumn(out, number.cast("int"))
    if said["names"] != 2:
        raise ValueError(f"labels need exactly two values, got {said['names']}")
    one = "ai" if {said["low"], said["high"]} == {"human", "ai"} else said["high"]
    return df.withColumn(out, (name == one).cast("int"))


def verdict(score: Column) -> Column:
    """The band of a probability; what is no number is unknown. NaN lies above all bands in Spark and below them here."""
    v = score.try_cast("double")
    # Lower ends of the bands and their messages.
    return (
        F.when(v.isNull(), F.concat(F.lit("Unknown Result (Raw: "), F.coalesce(score.cast("string"), F.lit("None")), F.lit(")")))
        .when(F.isnan(v), "Almost certainly human-generated")
        .when(v >= 0.90, "Very likely AI-generated")
        .when(v >= 0.75, "Likely AI-generated")
        .when(v >= 0.60, "Possibly AI-generated")
        .when(v >= 0.40, "Uncertain origin")
        .when(v >= 0.25, "Likely human-generated")
        .when(v >= 0.10, "Very likely human-generated")
        .otherwise("Almost certainly human-generated")
    )


def decision(p: Column, strict: bool = False) -> Column:
    """struct(label, confidence) with the winning side's probability. One half is AI, or with `strict` HUMAN, as a service's log has it."""
    return F.when(p > 0.5 if strict else p >= 0.5, F.struct(F.lit("AI").alias("label"), p.alias("confidence"))).otherwise(F.struct(F.lit("HUMAN").alias("label"), (1 - p).alias("confidence")))


def shown_decision(p: Column) -> Column:
    """struct(label, confidence, raw_score) as texts: the decision, its confidence in percent with one decimal, the score with four."""
    d = decision(p)
    return F.struct(d["label"].alias("label"), F.format_string("%.1f%%", d["confidence"] * 100).alias("confidence"), F.format_string("%.4f", p).alias("raw_score"))


def logged_decision(p: Column) -> Column:
    """The line that a service logs for a score: one above a half is AI, and the confidence is the score itself; minus one is an error code."""
    said = F.format_string("Classification: %s (confidence: %.2f%%)", F.when(p > 0.5, "AI").otherwise("HUMAN"), p * 100)
    return F.when(p == -1, "Model returned error code (-1.0).").otherwise(said)


def safe_float(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float("-inf")))


def positive_probability(probs: Column) -> Column:
    """The second of an array of class probabilities; fewer than two raise."""
    return F.when(F.size(probs) >= 2, F.element_at(probs, 2)).otherwise(F.raise_error(F.lit("two class probabilities are needed")))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def normalize_path(c: Column, root: str = "/app/") -> Column:
    """Forward slashes, under the root."""
    p = F.regexp_replace(c, r"\\", "/")
    return F.when(p.startswith(root), p).otherwise(F.concat(F.lit(root), F.regexp_replace(p, r"^(\./|/)+", "")))
