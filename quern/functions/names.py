"""Names for temporary columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name for each of `names` that no column of df has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        made = f"__{name}"
        while made.lower() in taken:
            made += "_"
        taken.add(made.lower())
        out.append(made)
    return out
