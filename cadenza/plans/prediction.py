"""One prediction row per record: FASTA records, decoded affinities and outside probabilities, composed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.sequence import MAXIMUM_LENGTH
from cadenza.operators import tiles as tl
from cadenza.operators.intervals import track_summary
from cadenza.plans.topology import decode
from cadenza.plugins import compose, one_to_one
from cadenza.session import materialize

#: Length up to which the published scores were evaluated.
EVALUATED_LENGTH = 1732


def topology_control_z(rows: DataFrame) -> Column:
    """The control z under either of its names; a record without one, or with one that isn't finite, stops the query."""
    own = [F.col(c).cast("double") for c in ("topology_control_z", "topology_development_control_z") if c in rows.columns]
    z = F.coalesce(*own, F.lit(None).cast("double"))
    name = F.col("record_id").cast("string") if "record_id" in rows.columns else F.lit("?")
    return F.when(z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf")), z).otherwise(F.raise_error(F.concat(F.lit("no finite topology control z: "), name)).cast("double"))


def flatten_features(features: Column, keys: list[str]) -> Column:
    """A map of named vectors as one vector, in the order of keys; a missing, empty or non-finite one stops the query."""
    if not keys or len(set(keys)) != len(keys):
        raise ValueError("feature keys must be unique and non-empty")
    parts = [F.try_element_at(features, F.lit(k)) for k in keys]
    flat = F.flatten(F.array(*parts))
    whole = F.array_min(F.array(*[F.coalesce(F.size(p) > 0, F.lit(False)) for p in parts]))
    finite = F.forall(flat, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole & finite, flat).otherwise(F.raise_error(F.lit("global features are missing, empty or not finite")))


#: Names of the fields a row is ranked by, and what the row is. Fixed values of the output's contract.
PRIMARY_FIELD = "discovery_score"
EVIDENCE = "UNVERIFIED sequence-model architecture classifier"
INTERPRETATION = "candidate ranking only; follow-up structure or annotation is required"


def teacher_states(logits: DataFrame, lengths: DataFrame, classes: list[str], threshold: float = 0.5) -> DataFrame:
    """A tile model's logits -> record_id, state_probability, teacher_state_summary, class_means: what a row keeps of the tracks.

    logits (record_id, core_start, channel, ti, tj, logit), lengths (record_id, length): see ``tiles.decode_tiles``.
    """
    track = materialize(tl.decode_tiles(logits.withColumnRenamed("record_id", "rec"), lengths.select(F.col("record_id").alias("rec"), "length"), classes), "teacher-track")
    summary = track_summary(track, "rec", "pos", "state", threshold)
    fields = {"mean": "mean_probability", "median": "median_probability", "q90": "q90_probability", "supported_fraction": "supported_fraction", "run_start": "longest_run_start", "run_end": "longest_run_end", "run_length": "longest_run_length", "run_fraction": "longest_run_fraction"}
    packed = summary.select("rec", F.col("mean").alias("state_probability"), F.struct(*[F.col(a).alias(b) for a, b in fields.items()]).alias("teacher_state_summary"))
    return packed.join(tl.class_means(track), "rec").withColumnRenamed("rec", "record_id")


def predict(records: DataFrame, affinities: DataFrame, probabilities: DataFrame, logits: DataFrame | None = None, classes: list[str] | None = None, **decoding) -> DataFrame:
    """records (record_id, sequence, sequence_sha256, length), affinities (record_id, layer, i, j, v), probabilities
    (record_id, global_probability, and state_probability where no logits are given) -> nested rows, one for each record.

    With logits (record_id, core_start, channel, ti, tj, logit) of a tile model the state's
    probability is the mean of the decoded track, and its summary and class means are in the
    row; else both are null. Keyword arguments go to ``topology.decode``. A record without
    affinities, a record with no or several probabilities, and probabilities of no record
    stop the query.
    """
    own = records.select("record_id", "length")
    if logits is None:
        scores = probabilities.select("record_id", "state_probability", "global_probability", F.lit(None).cast("struct<mean_probability: double>").alias("teacher_state_summary"), F.lit(None).cast("map<string, double>").alias("class_means"))
    else:
        heads = one_to_one(own, probabilities.select("record_id", "global_probability"))
        scores = teacher_states(logits, own, classes or []).join(heads, "record_id")
    topology = decode(affinities.withColumnRenamed("record_id", "rec"), own.withColumnRenamed("record_id", "rec"), **decoding)
    rows = compose(topology.drop("length").withColumnRenamed("rec", "record_id"), scores)
    joined = records.select("record_id", "sequence_sha256", "length").join(rows, "record_id", "left")
    status = F.coalesce("status", F.raise_error(F.concat(F.lit("no affinities: "), F.col("record_id").cast("string"))))
    call = F.when(F.col("call_start").isNotNull(), F.struct(F.col("call_start").alias("start"), F.col("call_end").alias("end"), F.col("call_period").alias("period"), (F.col("call_end") - F.col("call_start")).alias("window_size"), F.col("call_score").alias("score")))
    names = ("offset", "objective", "second_objective", "ambiguity_margin", "contrast", "edge_cv", "core_reference", "background", "threshold", "units", "n_tiles")
    scan = ("open_minimum", "open_q05", "open_q10", "open_median", "strongest", "other_count", "other_minimum", "other_strongest")
    some = lambda test, cols: F.when(F.col(test).isNotNull(), F.struct(*cols))
    return joined.select(
        "record_id", "sequence_sha256", "length", status.alias("status"), "frozen_spectrum", "candidate_periods", call.alias("wedge_call"), some("offset", names).alias("registration"),
        some("closure_open_score", ("n_units", "closure", "closure_adjacent", "closure_open_score")).alias("closure"), some("open_minimum", scan).alias("boundary_scan"),
        "candidate_count", "open_score_raw", "expected_open_score", "corrected_topology_score", F.col("topology_z").alias("topology_control_z"), "spectrum_z", "fusion_score",
        "state_probability", F.col("teacher_z").alias("state_z"), "global_probability", "global_z", "base_score", "primary_score", "discovery_score", F.lit(PRIMARY_FIELD).alias("primary_score_field"),
        "teacher_state_summary", F.col("class_means").alias("predicted_teacher_mean_class_probability"),
        F.struct(F.lit(MAXIMUM_LENGTH).alias("maximum"), F.lit(EVALUATED_LENGTH).alias("evaluated"), (F.col("length") > EVALUATED_LENGTH).alias("above_evaluated_length")).alias("length_scope"), (F.col("length") > EVALUATED_LENGTH).alias("above_evaluated_length"),
        F.lit(EVIDENCE).alias("evidence_status"), F.lit(INTERPRETATION).alias("interpretation"),
    )
