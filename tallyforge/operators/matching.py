"""Dictionary matching (R0): the longest phrase that a text contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_phrase(text: Column, dictionary: dict[str, str]) -> Column:
    """The value of the longest phrase in the text, of the earlier phrase among equals; else null.

    The dictionary is code, a few hundred phrases at most, so it travels in the plan: one
    scan per row, which ends at the first phrase found, and no join.
    """
    ranked = sorted(dictionary.items(), key=lambda x: -len(x[0]))
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(v)) for p, v in ranked])


def longest_match(df: DataFrame, text_col: str, dictionary: dict[str, str]) -> DataFrame:
    """Add ``match``: the longest phrase's value."""
    return df.withColumn("match", longest_phrase(F.col(text_col), dictionary))
