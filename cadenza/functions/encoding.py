"""Residue encodings and one-dimensional signal preparation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.sequence import noncanonical_residues

# Five physical factors of each residue.
ATCHLEY = {
    "A": (-0.591, -1.302, -0.733, 1.570, -0.146),
    "C": (-1.343, 0.465, -0.862, -1.020, -0.255),
    "D": (-0.798, 0.493, -0.686, -0.982, 1.564),
    "E": (-0.730, 0.063, -0.267, -0.837, 1.628),
    "F": (1.889, -0.273, 1.629, 0.801, -0.542),
    "G": (-0.270, 1.330, -0.871, -0.093, 0.179),
    "H": (0.608, 0.049, -0.007, -0.163, -0.044),
    "I": (0.825, -1.628, 0.544, 0.034, -0.680),
    "K": (1.139, 1.165, 0.283, -0.121, 0.778),
    "L": (1.056, -1.242, 0.693, -0.554, -0.347),
    "M": (0.940, -0.420, -0.032, -0.417, -0.273),
    "N": (-0.375, 1.020, -0.826, -0.014, 0.082),
    "P": (0.222, 2.043, -0.521, -0.098, 0.269),
    "Q": (0.093, 0.828, -0.179, -0.776, -0.165),
    "R": (1.491, 0.841, 1.063, 0.150, 0.360),
    "S": (-0.345, 0.443, -0.922, -0.410, -0.179),
    "T": (-0.199, 0.514, -0.598, 1.142, -0.121),
    "V": (0.282, -1.437, 0.379, 0.990, -0.623),
    "W": (2.213, -0.188, 2.067, 1.338, -0.450),
    "Y": (1.391, 0.231, 1.096, 1.253, -0.475),
}


def _rows() -> list[tuple[str, int, int]]:
    return [(r, k + 1, round(1000 * v)) for r, factors in ATCHLEY.items() for k, v in enumerate(factors)]


def table_sql() -> str:
    """The factors in thousandths, as SQL values."""
    return ", ".join(f"('{r}', {k}, {v})" for r, k, v in _rows())


def factor_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_rows(), "residue string, factor int, value long")


@F.pandas_udf(T.ArrayType(T.LongType()))
def residue_counts(sequences: pd.Series) -> pd.Series:
    """How often each residue occurs, in the table's order; one pass over the bytes."""
    codes = np.frombuffer("".join(ATCHLEY).encode(), np.uint8)
    return sequences.map(lambda s: np.bincount(np.frombuffer((s or "").encode(), np.uint8), minlength=256)[codes])


def composition(records: DataFrame, key: str, sequence: str) -> DataFrame:
    """key, residue, n. Counted record by record: nothing is exploded per position."""
    names = F.array(*[F.lit(r) for r in ATCHLEY])
    pairs = F.arrays_zip(names.alias("residue"), residue_counts(F.col(sequence)).alias("n"))
    each = records.select(key, F.explode(pairs).alias("c")).select(key, F.col("c.residue").alias("residue"), F.col("c.n").alias("n"))
    return each.filter("n > 0")


def factor_sums(records: DataFrame, key: str, sequence: str) -> DataFrame:
    """Sum of each factor over a sequence, in thousandths: key, factor, factor_sum."""
    factors = F.broadcast(factor_table(records.sparkSession))  # 100 rows
    return composition(records, key, sequence).join(factors, "residue").groupBy(key, "factor").agg(F.sum(F.col("n") * F.col("value")).alias("factor_sum"))


def _rows_of(sequence: Column, table: dict[str, tuple[float, ...]]) -> Column:
    """One row of the table per residue; an empty or noncanonical sequence stops the query. Every symbol is one look-up of its place in the alphabet."""
    letters = F.lit("".join(table))
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in table.values()])
    fault = F.raise_error(F.concat(F.lit("invalid sequence: "), F.array_join(noncanonical_residues(sequence), ""))).cast("string")
    checked = F.when(F.upper(sequence).rlike(rf"\A[{''.join(table)}]+\z"), F.upper(sequence)).otherwise(fault)
    return F.transform(F.split(checked, ""), lambda r: F.get(rows, F.instr(letters, r) - 1))


def encode_factors(sequence: Column) -> Column:
    """A canonical sequence as an array of rows of five factors, one per residue; null stays null."""
    return F.when(sequence.isNotNull(), _rows_of(sequence, ATCHLEY))


def encode_normalized_factors(sequence: Column) -> Column:
    """The factors, each divided by its norm over the alphabet."""
    norms = np.sqrt((np.array(list(ATCHLEY.values())) ** 2).sum(0))
    return F.when(sequence.isNotNull(), _rows_of(sequence, {r: tuple(v / n for v, n in zip(row, norms.tolist(), strict=True)) for r, row in ATCHLEY.items()}))


def encode_onehot(sequence: Column) -> Column:
    """A canonical sequence as an array of rows of twenty indicators, in the alphabet's order; null stays null."""
    return F.when(sequence.isNotNull(), _rows_of(sequence, {r: tuple(float(r == q) for q in ATCHLEY) for r in ATCHLEY}))


def detrended(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """key, pos, standardized: mean and least-squares line taken off, divided by the population deviation. Constant signals go."""
    fits = rows.groupBy(key).agg(F.avg(value).alias("__m"), F.regr_slope(value, pos).alias("__b"), F.avg(pos).alias("__t"))
    left = rows.join(fits, key).withColumn("__x", (F.col(value) - F.col("__m")) - F.coalesce("__b", F.lit(0.0)) * (F.col(pos) - F.col("__t")))
    spread = left.withColumn("__s", F.stddev_pop("__x").over(Window.partitionBy(key))).filter(F.col("__s") > 1e-12)
    return spread.select(key, pos, (F.col("__x") / F.col("__s")).alias("standardized"))
