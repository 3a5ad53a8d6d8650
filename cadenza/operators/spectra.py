"""Scans for periodicity: windows of sequences and of matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import calibration as cal
from cadenza.functions import spectral as sp
from cadenza.functions.window_scan import window_scores
from cadenza.operators.intervals import window_starts


#: Windows that are scored from one string.
STRIP = 64
_SCORES = ("physical", "exact", "factor_max", "repetita")


def score_windows(windows: DataFrame, sequence: str = "window", low: float = 5.0, high: float = 250.0, cycles: int = 3) -> DataFrame:
    """windows with a canonical string -> physical, factor_max (with factor), exact and repetita structs."""
    text = F.col(sequence)
    scored = windows.withColumn("__s", F.get(window_scores(text, F.length(text), F.array(F.lit(0)), low, high, cycles), 0))
    return scored.withColumns({k: F.col(f"__s.{k}") for k in _SCORES}).drop("__s")


def scan_sequences(records: DataFrame, sizes: tuple[int, ...] = (128, 256, 512, 1024)) -> DataFrame:
    """records (record_id, sequence) -> a row per multiscale window with its scores.

    Neighbouring windows of one size overlap by three quarters, so they go to the worker as
    strips of a sequence, each with the places of its windows.
    """
    sized = window_starts(records.select("record_id", "sequence", F.length("sequence").alias("length")), sizes)
    strips = sized.withColumn("own", F.explode(F.transform(F.sequence(F.lit(1), F.size("starts"), F.lit(STRIP)), lambda k: F.slice("starts", k, STRIP))))
    first, last = F.get("own", 0), F.element_at("own", -1)
    cut = strips.select("record_id", "window_size", "own", F.substring("sequence", first + 1, last + F.col("window_size") - first).alias("text"), F.transform("own", lambda s: s - F.get("own", 0)).alias("inside"))
    scored = cut.withColumn("scores", window_scores(F.col("text"), F.col("window_size"), F.col("inside")))
    rows = scored.select("record_id", "window_size", F.explode(F.arrays_zip("own", "scores")).alias("w"))
    return rows.select("record_id", F.col("w.own").alias("start"), (F.col("w.own") + F.col("window_size")).alias("end"), "window_size", *[F.col(f"w.scores.{k}").alias(k) for k in _SCORES])


def window_profiles(matrix: DataFrame, windows: DataFrame) -> DataFrame:
    """Diagonal profile inside each window: rec, layer, start, end, window_size, profile.

    Diagonals are summed by prefix once; a window's mean on a diagonal is a difference of two entries.
    """
    upper = matrix.filter("j > i").select("rec", "layer", (F.col("j") - F.col("i")).alias("sep"), "i", F.col("v").cast("double").alias("v"))
    upto = Window.partitionBy("rec", "layer", "sep").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"])
    prefix = upper.withColumn("s", F.sum("v").over(upto)).groupBy("rec", "layer", "sep").agg(F.concat(F.array(F.lit(0.0)), run).alias("p"))
    inside = prefix.join(windows, "rec").filter(F.col("sep") < F.col("window_size"))
    mean = (F.get("p", F.col("end") - F.col("sep")) - F.get("p", F.col("start"))) / (F.col("window_size") - F.col("sep"))
    rows = inside.select("rec", "layer", "start", "end", "window_size", "sep", mean.alias("m"))
    return rows.groupBy("rec", "layer", "start", "end", "window_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("sep", "m"))), lambda t: t["m"]).alias("profile"))


def _median(values: Column) -> Column:
    """Median of an array of doubles; 0 where it is empty."""
    x, n = F.array_sort(values), F.size(values)
    return F.coalesce((F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2, F.lit(0.0))


def score_profiles(profiles: DataFrame, cycles: int = 3) -> DataFrame:
    """profiles with score, period, n_harmonics and harmonic_z of the best comb, and profile_mad: the median distance of the profile from its median."""
    n = F.greatest(F.size("profile"), F.lit(1))
    scored = profiles.withColumn("__z", sp.profile_spectrum(F.col("profile")))
    call = sp.comb(F.col("__z.z"), n, high=F.least(F.lit(250.0), n / cycles), cycles=cycles)
    scored = scored.withColumns({"__c": call, "__m": _median(F.col("profile"))})
    mad = _median(F.transform("profile", lambda x: F.abs(x - F.col("__m"))))
    own = {"score": "score", "period": "period", "n_significant": "n_harmonics", "harmonic_z": "harmonic_z"}
    return scored.select(*[c for c in profiles.columns if c != "profile"], *[F.col(f"__c.{a}").alias(b) for a, b in own.items()], mad.alias("profile_mad"))


def fused_windows(scored: DataFrame, lengths: DataFrame, calibration: dict = cal.LOCAL) -> DataFrame:
    """Layers' window scores -> one row per window: score (mean z), period and n_harmonics of the layer with the largest z, and layer_residual_z, a map of each layer's z.

    A window that lacks a layer stops the query; of equal z the first layer counts.
    """
    table = F.broadcast(cal.layer_table(scored.sparkSession, calibration))  # a row per layer
    z = cal.window_z(F.col("score"), F.col("window_size"), F.col("length"), F.col("coefficients"), F.col("mean"), F.col("sd"))
    rows = scored.join(lengths, "rec").join(table, "layer").withColumn("z", z)
    top = F.max(F.struct("z", (-F.col("layer")).alias("back"), "period", "n_harmonics"))
    fused = rows.groupBy("rec", "start", "end", "window_size").agg(F.count_distinct("layer").alias("n"), F.avg("z").alias("score"), top.alias("t"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("layer").cast("string"), "z")))).alias("layer_residual_z"))
    period = F.when(F.col("n") == len(calibration), F.col("t.period")).otherwise(F.raise_error(F.lit("window without all layers")))
    return fused.select("rec", "start", "end", "window_size", "score", period.alias("period"), F.col("t.n_harmonics").alias("n_harmonics"), (-F.col("t.back")).alias("source_layer"), "layer_residual_z")
