"""Checks that are part of the plan: nothing runs while a plan is built, and the one job that reads the rows fails where a check does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh


def no_row(df: DataFrame, bad: Column, *message) -> DataFrame:
    """df; reading a row for which `bad` holds is an error. The message is put together from texts and columns."""
    said = F.concat_ws("", *[m.cast("string") if isinstance(m, Column) else F.lit(m) for m in message])
    return df.where(F.when(bad, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def fact(df: DataFrame, facts: DataFrame, bad: Column, *message) -> DataFrame:
    """df; reading it is an error if `bad` holds for the one row of facts, which is computed in the same query and sent to all tasks."""
    (ok,) = fresh(df, "ok")
    one = no_row(facts, bad, *message).select(F.lit(True).alias(ok))
    return df.crossJoin(F.broadcast(one)).drop(ok)
