"""Rows carried whole through an operator, so that its working columns meet none of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed_rows(docs: DataFrame, *used: str) -> DataFrame:
    """docs -> row (a struct of all columns) and the columns that are used, beside it. ``row.*`` gives the columns back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *used)
