"""Scorers that need fitted models come from outside: their outputs are tables.

No model weights are part of this repository. A global head's output is a table
(record_id, global_probability), a tile model's a table of logits
(``operators.tiles.decode_tiles``), or ready state probabilities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import calibration as cal


def one_to_one(records: DataFrame, scores: DataFrame, key: str = "record_id") -> DataFrame:
    """scores, if each record has exactly one row of them and no row is another record's; else the query stops and names the key.

    A null key is another record's. records hold each key once.
    """
    known = records.select(F.col(key).alias("__key"), F.lit(True).alias("__known"))
    rows = scores.groupBy(key).agg(F.count("*").alias("__n"), F.any_value(F.struct("*")).alias("__row"))
    met = rows.join(known, F.col(key) == F.col("__key"), "full")
    fault = F.when(F.col("__known").isNull(), "scores of no record: ").when(F.col("__n").isNull(), "no scores: ").when(F.col("__n") > 1, "scores occur more than once: ")
    name = F.coalesce(F.col(key).cast("string"), F.col("__key").cast("string"), F.lit("null"))
    kind = met.schema["__row"].dataType.simpleString()
    row = F.when(fault.isNull(), F.col("__row")).otherwise(F.raise_error(F.concat(fault, name)).cast(kind))
    return met.select(row.alias("r")).select("r.*")


def compose(topology: DataFrame, probabilities: DataFrame, key: str = "record_id") -> DataFrame:
    """One score row per record; a record without probabilities or with several, probabilities of no record, and one outside 0..1 stop the query."""
    rows = topology.join(one_to_one(topology, probabilities, key), key)
    valid = F.col("state_probability").between(0, 1) & F.col("global_probability").between(0, 1)
    state = F.when(valid, F.col("state_probability")).otherwise(F.raise_error(F.lit("probabilities are missing or outside 0..1")))
    scores = cal.compose_score(state, F.col("topology_z"), F.col("global_probability"), cal.TEACHER_LOGIT, cal.GLOBAL_LOGIT)
    return rows.select("*", *[v.alias(k) for k, v in scores.items()])
