"""The most frequent keys of a count table, within a bound on what reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cadenza.session import materialize


def most_frequent(counts: DataFrame, limit: int, *ties: str) -> list[Row]:
    """Of counts (.., n) the ``limit`` rows with the largest n, ties by the given columns.

    A histogram over steps of n (64 per doubling) first finds the step in which the last
    of them lies, so that tasks send no more than about ``limit`` rows in all.
    """
    counts = materialize(counts, "counts")
    step = F.floor(F.log2(F.col("n").cast("double")) * 64)
    histogram = counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect()  # at most 64 * 64 rows
    held, least = 0, None
    for s, n in histogram:
        held, least = held + n, s
        if held >= limit:
            break
    if least is None:
        return []
    return counts.filter(step >= least).orderBy(F.desc("n"), *ties).limit(limit).collect()
