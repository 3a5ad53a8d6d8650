"""Strict sequence checks as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
MAXIMUM_LENGTH = 2046


def noncanonical_residues(sequence: Column) -> Column:
    """Sorted distinct symbols of the upper-cased sequence that are no canonical residue."""
    letters = F.split(F.regexp_replace(F.upper(sequence), f"[{CANONICAL}]", ""), "")
    return F.array_sort(F.array_remove(F.array_distinct(letters), ""))


def strip_stop(sequence: Column) -> Column:
    """Upper case, one trailing stop mark taken off."""
    return F.regexp_replace(F.upper(sequence), r"\*\z", "")


def sequence_status(sequence: Column, maximum: int = MAXIMUM_LENGTH) -> Column:
    """ok, empty, noncanonical or too_long; the first that applies. A null counts as empty."""
    return (
        F.when(F.coalesce(F.length(sequence), F.lit(0)) == 0, "empty")
        .when(~F.upper(sequence).rlike(rf"\A[{CANONICAL}]+\z"), "noncanonical")
        .when(F.length(sequence) > maximum, "too_long")
        .otherwise("ok")
    )


def sequence_digest(sequence: Column) -> Column:
    return F.sha2(sequence.cast("binary"), 256)


def require_canonical(records: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Upper-case the column; a row that is empty or noncanonical stops the query."""
    bad = F.concat(F.lit("invalid sequence: "), F.array_join(noncanonical_residues(F.col(sequence)), ""))
    ok = F.upper(F.col(sequence)).rlike(rf"\A[{CANONICAL}]+\z")
    return records.withColumn(sequence, F.when(ok, F.upper(F.col(sequence))).otherwise(F.raise_error(bad)))


def noncanonical_map(sequences: Column) -> Column:
    """Map of id to sequence -> map of the ids whose sequence is null, empty or noncanonical to the symbols at fault (none: empty or null)."""
    checked = F.transform_values(sequences, lambda _, s: F.when(s.isNull() | (s == ""), F.lit("")).otherwise(F.array_join(noncanonical_residues(s), "")))
    ok = lambda s: F.coalesce(F.upper(s).rlike(rf"\A[{CANONICAL}]+\z"), F.lit(False))
    return F.map_filter(checked, lambda k, _: ~ok(F.try_element_at(sequences, k)))


def require_canonical_map(sequences: Column) -> Column:
    """The map with its sequences in upper case; a sequence that is empty or noncanonical stops the query and names its id. A null map stays null."""
    bad = noncanonical_map(sequences)
    first = F.get(F.array_sort(F.map_entries(bad)), F.lit(0))
    fault = F.concat(F.lit("invalid sequence of "), first["key"].cast("string"), F.lit(": "), first["value"])
    upper = F.transform_values(sequences, lambda _, s: F.upper(s))
    return F.when(F.coalesce(F.size(bad), F.lit(0)) <= 0, upper).otherwise(F.raise_error(fault))


def record_issues(records: DataFrame, maximum: int = MAXIMUM_LENGTH) -> DataFrame:
    """One row of counts: records, ids that occur twice, empty, noncanonical, too long, wrong digest.

    A run starts only if all counts but the first are 0; this is one aggregate ahead of it.
    """
    status = sequence_status(F.col("sequence"), maximum)
    twice = records.groupBy("record_id").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("duplicate_ids"))
    counts = records.agg(
        F.count("*").alias("records"),
        *[F.count_if(status == s).alias(s) for s in ("empty", "noncanonical", "too_long")],
        F.count_if(F.col("sequence_sha256") != sequence_digest(F.col("sequence"))).alias("digest_mismatch"),
    )
    return counts.crossJoin(F.broadcast(twice))  # one row each
