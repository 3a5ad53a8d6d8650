"""The whole decoding of affinity matrices: from cells to one scored row per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import calibration as cal
from cadenza.operators import intervals as iv
from cadenza.operators import matrices as mx
from cadenza.operators import registration as rg
from cadenza.operators import spectra as spx
from cadenza.operators import wedge as wg
from cadenza.session import materialize


def decode(matrix: DataFrame, lengths: DataFrame, window_sizes: tuple[int, ...] = (64, 96, 128, 192, 256, 384, 512), widths: tuple[int, ...] = tuple(range(96, 513, 32)), most: int = 256, least_size: int = 96) -> DataFrame:
    """matrix (rec, layer, i, j, v) of two layers, lengths (rec, length) -> a row per record.

    The columns are those of a topology prediction: the call and its width, the registration
    with its margins and units, the closure's block means, the boundary scan with the spans
    that set its minima, the candidate periods, the nested spectrum of each layer, and the
    calibrated scores. Spectrum per layer, multiscale windows, candidate periods, wedge call, unit
    registration, closure, boundary scan, calibrated scores. A record without a wedge call,
    or whose units can't be registered, has status no_wedge_call and null call columns.
    """
    spark = matrix.sparkSession
    matrix = materialize(matrix, "matrix")  # read by five branches
    whole = lengths.withColumns({"start": F.lit(0), "end": F.col("length"), "window_size": F.col("length")})
    features = spx.score_profiles(spx.window_profiles(matrix, whole.drop("length"))).join(lengths, "rec").select("rec", "length", "layer", "score")
    listed = features.groupBy("rec").agg(F.first("length").alias("length"), F.collect_list(F.struct("layer", "score")).alias("f"))
    spectrum = listed.select("rec", cal.frozen_spectrum(cal.layer_score_map(F.col("f")), F.col("length")).alias("frozen_spectrum"))
    spectrum = spectrum.withColumn("spectrum_score", F.col("frozen_spectrum.score"))
    plan = iv.window_plan(lengths, window_sizes).drop("length")
    windows = spx.fused_windows(spx.score_profiles(spx.window_profiles(matrix, plan)), lengths)
    periods = materialize(iv.candidate_periods(windows, "rec", least_size), "periods")
    hypotheses = periods.groupBy("rec").agg(F.sort_array(F.collect_list("period")).alias("candidate_periods"))
    templates = periods.crossJoin(F.broadcast(spark.createDataFrame([(w,) for w in widths], "width int")))
    fused = materialize(mx.fuse_tracks(mx.diagonal_tracks(matrix, most)), "tracks")
    calls = wg.best_interval(wg.start_scores(fused, lengths, templates)).join(lengths, "rec")
    calls = materialize(calls, "calls")
    one = matrix.filter(F.col("layer") == cal.LAYERS[1])
    registered = materialize(rg.register_units(one, calls), "units")
    tiles = iv.periodic_tiles(registered.join(lengths, "rec").join(calls.select("rec", "period"), "rec").select("rec", "length", "period", "offset"))
    order = Window.partitionBy("rec").orderBy("start")
    all_units = tiles.select("rec", (F.row_number().over(order) - 1).alias("unit"), "start", "end")
    core = registered.select("rec", F.col("core_first").alias("first"), F.col("core_last").alias("last"))
    scan = mx.boundary_scan(mx.boundary_candidates(mx.block_means(one, all_units), core)).drop("layer")
    own_units = registered.select("rec", F.posexplode("units").alias("unit", "u")).select("rec", "unit", F.col("u.start").alias("start"), F.col("u.end").alias("end"))
    closure = mx.closure_scores(mx.block_means(one, own_units)).select("rec", "n_units", "closure", F.col("adjacent").alias("closure_adjacent"), F.col("open_score").alias("closure_open_score"))
    calls = calls.select("rec", "period", "start", "end", "score").toDF("rec", "call_period", "call_start", "call_end", "call_score")
    rows = lengths.join(spectrum, "rec").join(hypotheses, "rec", "left").join(calls, "rec", "left").join(registered, "rec", "left").join(closure, "rec", "left").join(scan, "rec", "left")
    rows = rows.withColumn("status", F.when(F.col("candidate_count") > 0, "ok").otherwise("no_wedge_call"))
    scores = cal.operational_scores(F.col("status"), F.col("candidate_count"), F.col("open_minimum"), F.col("spectrum_score"))
    periods = F.coalesce("candidate_periods", F.array().cast("array<double>")).alias("candidate_periods")
    return rows.select("rec", "length", "status", "spectrum_score", "frozen_spectrum", periods, "call_period", "call_start", "call_end", "call_score", *[c for c in registered.columns if c != "rec"], "n_units", "closure", "closure_adjacent", "closure_open_score", *[c for c in scan.columns if c not in ("rec", "candidate_count")], *[v.alias(k) for k, v in scores.items()])
