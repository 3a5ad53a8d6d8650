"""Dense ranks and ranked reports over range partitions: no key, and no group, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.order import numbered
from cadenza.session import materialize, small_side


def finite(value: Column) -> Column:
    """value as a double; a null, NaN or infinity stops the query."""
    x = value.cast("double")
    return F.when(F.coalesce(F.abs(x) < float("inf"), F.lit(False)), x + 0.0).otherwise(F.raise_error(F.lit("values to rank must be finite")).cast("double"))


def dense_ranks(rows: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """rows with ``name`` (int): the dense rank of their value, from the largest, in their group.

    The distinct values (of each group) are range-partitioned and numbered by the partitions'
    counts; a group's first number is its offset. Rows meet their value in a join whose hot
    values AQE splits, so ties and a group that holds most rows are spread. Null keys are a
    group; zeros of either sign are one value; an empty table gives an empty table.
    """
    own = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    marked = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), own.alias("group"), finite(F.col(value)).alias("value"))
    values = materialize(marked.select("group", "value").distinct(), "ranked-values")
    placed = numbered(values, [F.col("group"), F.desc("value")], "ranked-places")
    begins = materialize(placed.groupBy(F.col("group").alias("of")).agg(F.min("place").alias("begin")), "ranked-groups")
    ranks = placed.join(small_side(begins), F.col("group").eqNullSafe(F.col("of")))
    ranks = materialize(ranks.select(F.col("group").alias("of"), F.col("value").alias("at"), (F.col("place") - F.col("begin") + 1).cast("int").alias("rank")), "ranks")
    met = marked.join(small_side(ranks), F.col("group").eqNullSafe(F.col("of")) & (F.col("value") == F.col("at")))
    return met.select("row.*", F.col("rank").alias(name))


def report_lines(rows: DataFrame, score: str, columns: Sequence[Column], ties: Sequence[str]) -> DataFrame:
    """rows -> place (from 0), line: tab-separated columns (null: empty), the largest score first, equal ones by ``ties``.

    A column's tabs and line ends become blanks, so that a row stays a line of as many fields.
    """
    cells = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\n\r]", " ") for c in columns]
    lines = rows.select(finite(F.col(score)).alias("score"), F.struct(*ties).alias("ties"), F.concat_ws("\t", *cells).alias("line"))
    return numbered(materialize(lines, "report"), [F.desc("score"), F.col("ties"), F.col("line")], "report-places").select("place", "line")


def write_report(rows: DataFrame, score: str, columns: Sequence[Column], ties: Sequence[str], path: str) -> None:
    """The report as text files whose names sort in the order of their lines; an existing path is an error."""
    ordered = report_lines(rows, score, columns, ties).repartitionByRange("place").sortWithinPartitions("place")
    ordered.select("line").write.mode("error").text(path)


def prediction_columns() -> list[Column]:
    """Fields of a prediction's line in the report."""
    return [F.col(c) for c in ("record_id", "length", "discovery_score", "state_z", "global_z", "wedge_call.start", "wedge_call.end", "wedge_call.period")]
