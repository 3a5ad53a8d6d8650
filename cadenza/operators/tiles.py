"""Fixed-size tiles along the diagonal: dense inputs of a tile model, and its outputs back as tracks.

No model is part of this repository: ``dense_tiles`` makes what one reads, and
``decode_tiles`` takes its outputs as a table of logits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.calibration import stable_sigmoid
from cadenza.operators.matrices import robust_channel, tile_cells

TILE, CORE = 128, 64


def attention_channels(matrix: DataFrame, quantile: float = 0.95, clip: float = 8.0) -> DataFrame:
    """matrix (rec, layer, i, j, v), all cells -> rec, channel, i, j, c: a robust channel for each layer, numbered in their order.

    Layers of one record that differ in size, matrices that aren't square and whole, and cells
    that are null, negative or not finite stop the query; layers of records may differ.
    """
    sizes = matrix.groupBy("rec", "layer").agg((F.max("i") + 1).alias("n"), (F.max("j") + 1).alias("m"), F.count("*").alias("cells"), F.min(F.least("i", "j")).alias("least"), F.count_if(~F.coalesce((F.col("v") >= 0) & (F.col("v") < float("inf")), F.lit(False))).alias("bad"))
    square = (F.col("n") == F.col("m")) & (F.col("cells") == F.col("n").cast("long") * F.col("n")) & (F.col("least") == 0)
    layers = sizes.groupBy("rec").agg(F.array_sort(F.collect_list("layer")).alias("layers"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.bool_and(square).alias("square"), F.sum("bad").alias("bad"))
    fault = F.when(F.col("bad") > 0, "cells are null, negative or not finite").when(~F.col("square"), "matrix must be square and whole").when(F.col("lo") < F.col("hi"), "channel shapes disagree")
    checked = layers.select("rec", F.when(fault.isNull(), F.col("layers")).otherwise(F.raise_error(F.concat_ws(": ", fault, F.col("rec").cast("string"))).cast("array<int>")).alias("layers"))
    channels = robust_channel(matrix, quantile, clip).join(checked, "rec")
    return channels.select("rec", (F.array_position("layers", F.col("layer")) - 1).cast("int").alias("channel"), "i", "j", "c")


def dense_tiles(channels: DataFrame, lengths: DataFrame, n_channels: int, tile: int = TILE, core: int = CORE) -> DataFrame:
    """channels (rec, channel, i, j, c), lengths (rec, length) -> rec, core_start, tile: array of channels of tile x tile floats in rows.

    Beyond the record a tile is padded by zeros; the last channel is 1 where both positions
    exist. Every tile of every record comes out, also one without cells. Sparse cells are
    grouped by tile, which bounds a group by the tile's size.
    """
    if tile < core or core < 1 or (tile - core) % 2:
        raise ValueError("tile minus core must be even and not negative")
    margin = (tile - core) // 2
    cells = tile_cells(channels.toDF("rec", "layer", "i", "j", "v"), lengths, tile, core).withColumn("v", F.col("v").cast("float"))
    spans = lengths.select("rec", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(core))).alias("core_start"))
    marks = spans.select("rec", "core_start", "length", *[F.lit(None).cast(t).alias(c) for c, t in (("layer", "int"), ("ti", "int"), ("tj", "int"), ("v", "float"))])
    rows = cells.withColumn("length", F.lit(None).cast("int")).unionByName(marks)
    kind = pa.list_(pa.list_(pa.float32()))
    rec_type = dict(lengths.dtypes)["rec"]

    def scatter(table: pa.Table) -> pa.Table:
        length = max(n for n in table.column("length").to_pylist() if n is not None)
        begin = table.column("core_start")[0].as_py() - margin
        out = np.zeros((n_channels + 1, tile, tile), np.float32)
        own = table.filter(pc.is_valid(table.column("layer")))
        at = tuple(own.column(c).to_numpy() for c in ("layer", "ti", "tj"))
        out[at] = own.column("v").to_numpy()
        lo, hi = max(0, -begin), min(tile, length - begin)
        out[n_channels, lo:hi, lo:hi] = 1.0
        return pa.table({"rec": table.column("rec")[:1], "core_start": pa.array([begin + margin], pa.int32()), "tile": pa.array([list(out.reshape(n_channels + 1, -1))], kind)})

    return rows.groupBy("rec", "core_start").applyInArrow(scatter, f"rec {rec_type}, core_start int, tile array<array<float>>")


def decode_tiles(logits: DataFrame, lengths: DataFrame, classes: list[str], tile: int = TILE, core: int = CORE) -> DataFrame:
    """logits (rec, core_start, channel, ti, tj, logit), lengths (rec, length) -> rec, pos, state, classes.

    A tile speaks for its central diagonal alone, so padding never counts. Channel 0 is the
    state's logit (sigmoid), the others are those of the classes (softmax): a map of name to
    probability. A position that no tile or several tiles cover, a channel that is missing,
    doubled or surplus, and a logit that isn't finite stop the query.
    """
    margin = (tile - core) // 2
    pos = F.col("core_start") + F.col("ti") - margin
    core_rows = logits.filter((F.col("ti") == F.col("tj")) & (F.col("ti") >= margin) & (F.col("ti") < margin + core))
    places = core_rows.groupBy("rec", pos.cast("int").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("channel", F.col("logit").cast("double").alias("logit")))).alias("x"))
    wanted = lengths.select("rec", "length", F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))).alias("pos"))
    found = wanted.join(places, ["rec", "pos"], "left")
    channels, values = F.transform("x", lambda c: c["channel"].cast("int")), F.transform("x", lambda c: c["logit"])
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fault = (
        F.when(F.col("x").isNull() | (F.size("x") == 0), "no tile covers")
        .when(channels != F.array(*[F.lit(k) for k in range(1 + len(classes))]), "tiles do not cover exactly once, or channels differ, at")
        .when(~finite, "logits are not finite at")
    )
    checked = F.when(fault.isNull(), values).otherwise(F.raise_error(F.concat_ws(" ", fault, F.col("rec").cast("string"), F.col("pos").cast("string"))).cast("array<double>"))
    rest = F.slice("v", 2, len(classes))
    powers = F.transform(rest, lambda v: F.exp(v - F.array_max(rest)))
    shares = F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda s, x: s + x))
    names = F.array(*[F.lit(c) for c in classes])
    return found.select("rec", "pos", checked.alias("v")).select("rec", "pos", stable_sigmoid(F.get("v", F.lit(0))).alias("state"), F.map_from_arrays(names, shares).alias("classes"))


def class_means(track: DataFrame) -> DataFrame:
    """track (rec, pos, state, classes) -> rec, class_means: a map of class name to its mean probability."""
    means = track.select("rec", F.explode("classes").alias("name", "p")).groupBy("rec", "name").agg(F.avg("p").alias("p"))
    return means.groupBy("rec").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "p")))).alias("class_means"))
