"""Operators on square affinity matrices in long form.

A matrix is the rows (rec, layer, i, j, v) of all its cells; a track is the rows
(rec, layer, sep, pos, z) of its upper diagonals. The long form is for records of some
hundred positions, whose number grows with the data; all aggregates combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept_positions(mask: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """mask (rec, i, special, attended) -> rec, place: for each position, from 0, its number among those that are attended and not special (null: dropped).

    expected (rec, length): a record that keeps another number of positions, or that one side lacks, stops the query.
    """
    kept = F.coalesce(~F.col("special").cast("boolean") & F.coalesce(F.col("attended").cast("boolean"), F.lit(True)), F.lit(False))
    rows = mask.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("i", kept.alias("kept")))).alias("m"))
    gap = F.raise_error(F.lit("mask positions aren't 0, 1, 2, ..")).cast("array<int>")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("place"))
    number = F.aggregate("m", start, lambda held, x: F.struct((held["n"] + x["kept"].cast("int")).alias("n"), F.concat(held["place"], F.array(F.when(x["kept"], held["n"]))).alias("place")))
    whole = F.forall(F.sequence(F.lit(0), F.size("m") - 1), lambda k: F.get("m", k)["i"] == k)
    out = rows.select("rec", number.alias("p"), whole.alias("whole")).select("rec", F.when(F.col("whole"), F.col("p.place")).otherwise(gap).alias("place"), F.col("p.n").alias("n"))
    if expected is not None:
        disagree = F.raise_error(F.concat(F.lit("kept positions disagree with the length of "), F.col("rec").cast("string"))).cast("array<int>")
        out = out.join(expected.select("rec", "length"), "rec", "full").withColumn("place", F.when(F.col("n") == F.col("length"), F.col("place")).otherwise(disagree))
    return out.select("rec", "place")


def cropped(cells: DataFrame, positions: DataFrame) -> DataFrame:
    """cells (rec, .., i, j, v) with both axes compacted to the kept positions (rec, place); cells of other positions go."""
    named = cells.join(positions, "rec").withColumns({"i": F.get("place", "i"), "j": F.get("place", "j")})
    return named.filter(F.col("i").isNotNull() & F.col("j").isNotNull()).select(*cells.columns)


def apc_head_mean(cells: DataFrame, least_separation: int = 6, positions: DataFrame | None = None) -> DataFrame:
    """cells (rec, layer, head, i, j, v) -> rec, layer, i, j, v.

    Symmetrise, keep the given positions (``kept_positions``) under new numbers, take row times
    column over total off each head, cut at zero, average the heads, and zero the diagonal
    and what lies closer to it than the least separation. Sums are over kept positions alone.
    A cell whose transpose is absent counts it as zero. All sums of a head come from one
    exchange; the heads' mean is the second.
    """
    key = ["rec", "layer", "head"]
    own = cells if positions is None else cropped(cells, positions)
    dealt = own.select(*key, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "v").repartition(*key)
    half = dealt.groupBy(*key, "lo", "hi").agg(F.sum("v").alias("s"))
    place = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"))
    sides = F.when(F.col("lo") == F.col("hi"), F.array(place("lo", "hi"))).otherwise(F.array(place("lo", "hi"), place("hi", "lo")))
    value = F.when(F.col("lo") == F.col("hi"), F.col("s")).otherwise(F.col("s") / 2)
    sym = half.select(*key, value.alias("v"), F.explode(sides).alias("at")).select(*key, "at.i", "at.j", "v")
    total = lambda *by: F.sum("v").over(Window.partitionBy(*key, *by))
    sums = sym.select(*key, "i", "j", "v", total("i").alias("r")).withColumn("c", total("j")).withColumn("t", total())
    cut = F.greatest(F.lit(0.0), F.col("v") - F.col("r") * F.col("c") / (F.col("t") + F.lit(1e-12)))
    mean = sums.groupBy("rec", "layer", "i", "j").agg(F.avg(cut).alias("v"))
    return mean.withColumn("v", F.when(F.abs(F.col("i") - F.col("j")) < max(1, least_separation), 0.0).otherwise(F.col("v")))


def diagonal_profile(matrix: DataFrame) -> DataFrame:
    """Mean of each upper diagonal: rec, layer, sep, mean."""
    upper = matrix.filter("j > i")
    return upper.groupBy("rec", "layer", (F.col("j") - F.col("i")).alias("sep")).agg(F.avg("v").alias("mean"))


def diagonal_tracks(matrix: DataFrame, most: int, quantile: float = 0.25, clip: float = 8.0) -> DataFrame:
    """Upper diagonals up to separation ``most``, above a low quantile and in robust deviations: rec, layer, sep, pos, z.

    The deviation is 1.4826 times the median distance from the median; where that
    vanishes the population deviation, and where that does too the track is zero. The
    population deviation comes from sums of n v and its square, which are exact for whole
    numbers, so it doesn't depend on the order of rows.
    """
    key = ["rec", "layer", "sep"]
    d = matrix.filter((F.col("j") > F.col("i")) & (F.col("j") - F.col("i") <= most)).select("rec", "layer", (F.col("j") - F.col("i")).alias("sep"), F.col("i").alias("pos"), F.col("v").cast("double").alias("v"))
    first = d.groupBy(*key).agg(F.percentile("v", quantile).alias("base"), F.median("v").alias("mid"), F.sum("v").alias("total"), F.count("*").alias("n"))
    near = d.join(first, key)
    off = F.col("n") * F.col("v") - F.col("total")
    spread = near.groupBy(*key).agg(F.median(F.abs((F.col("v") - F.col("base")) - (F.col("mid") - F.col("base")))).alias("mad"), F.sqrt(F.sum(off * off) / F.first("n")).alias("root"))
    s, above = F.lit(1.4826) * F.col("mad"), F.col("v") - F.col("base")
    raw = F.when(s >= 1e-12, above / s).when(F.col("root") / F.col("n") >= 1e-12, above * F.col("n") / F.col("root"))
    z = F.when(raw.isNull(), 0.0).otherwise(F.least(F.lit(clip), F.greatest(F.lit(-clip), raw)))
    return near.join(spread, key).select(*key, "pos", z.alias("z"))


def fuse_tracks(tracks: DataFrame) -> DataFrame:
    """Mean over the layers, for separations that all layers of the record have: rec, sep, pos, z."""
    layers = tracks.groupBy("rec").agg(F.count_distinct("layer").alias("n_layers"))
    fused = tracks.groupBy("rec", "sep", "pos").agg(F.avg("z").alias("z"), F.count("*").alias("n"))
    return fused.join(layers, "rec").filter("n = n_layers").select("rec", "sep", "pos", "z")


def phase_randomized(tracks: DataFrame, seed: str) -> DataFrame:
    """Each track turned by a hash-drawn shift of its own: values stay, their shared phase goes."""
    whole = Window.partitionBy("rec", "layer", "sep")
    turned = tracks.withColumn("__n", F.count("*").over(whole))
    drawn = F.md5(F.concat_ws(":", F.lit(seed), "rec", "layer", "sep"))
    shift = F.conv(F.substring(drawn, 1, 12), 16, 10).cast("long") % F.col("__n")
    return turned.withColumn("pos", F.pmod(F.col("pos") + shift, F.col("__n")).cast("int")).drop("__n")


def robust_channel(matrix: DataFrame, quantile: float = 0.95, clip: float = 8.0) -> DataFrame:
    """Values scaled by a high quantile of the positive ones and squeezed to 0..1: rec, layer, i, j, c."""
    scale = matrix.filter("v > 0").groupBy("rec", "layer").agg(F.percentile(F.col("v").cast("double"), quantile).alias("s"))
    top = F.log1p(F.lit(clip))
    c = F.when(F.col("s") > 0, F.least(F.greatest(F.log1p(F.col("v") / F.col("s")), F.lit(0.0)), top) / top).otherwise(0.0)
    return matrix.join(scale, ["rec", "layer"], "left").select("rec", "layer", "i", "j", c.alias("c"))


def tile_cells(matrix: DataFrame, lengths: DataFrame, tile: int = 128, core: int = 64) -> DataFrame:
    """Cells of each tile of a record, in the tile's coordinates: rec, layer, core_start, ti, tj, v. Cells beyond the record are absent (zero).

    A position lies in two tiles at most on each axis, so its tiles are computed, not searched by a range join.
    """
    margin, steps = (tile - core) // 2, tile // core
    first = lambda c: F.floor((F.col(c) + margin) / core) - (steps - 1)
    cores = F.array_intersect(F.sequence(first("i"), first("i") + steps - 1), F.sequence(first("j"), first("j") + steps - 1))
    spread = matrix.join(lengths, "rec").withColumn("core_start", F.explode(cores)).withColumn("core_start", F.col("core_start") * core).filter((F.col("core_start") >= 0) & (F.col("core_start") < F.col("length")))
    begin = F.col("core_start") - margin
    return spread.select("rec", "layer", F.col("core_start").cast("int").alias("core_start"), (F.col("i") - begin).cast("int").alias("ti"), (F.col("j") - begin).cast("int").alias("tj"), "v")


def pooled_features(hidden: DataFrame) -> DataFrame:
    """hidden (rec, layer, values array) -> rec, layer, dim, mean, sd (population) over the positions."""
    flat = hidden.select("rec", "layer", F.posexplode("values").alias("dim", "x"))
    return flat.groupBy("rec", "layer", "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def block_means(matrix: DataFrame, units: DataFrame, reach: int | None = None) -> DataFrame:
    """Mean of every block of two units (a <= b, b - a <= reach): rec, layer, a, b, mean.

    Each position is given its unit by an equi-join, so all blocks come from one pass over
    the cells. units (rec, unit, start, end) don't overlap.
    """
    places = units.select("rec", "unit", F.explode(F.sequence("start", F.col("end") - 1)).alias("p"))
    rows, cols = places.toDF("rec", "a", "i"), places.toDF("rec", "b", "j")
    both = matrix.join(rows, ["rec", "i"]).join(cols, ["rec", "j"]).filter("a <= b" if reach is None else f"a <= b AND b - a <= {reach}")
    return both.groupBy("rec", "layer", "a", "b").agg(F.avg("v").alias("mean"))


def integral_sums(matrix: DataFrame) -> DataFrame:
    """matrix (rec, i, j, v), all cells -> rec, i, j, s: the sum of all cells up to and with (i, j)."""
    upto = lambda key, by: Window.partitionBy("rec", key).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = matrix.select("rec", "i", "j", F.sum("v").over(upto("i", "j")).alias("__r"))
    return rows.select("rec", "i", "j", F.sum("__r").over(upto("j", "i")).alias("s"))


def block_means_by_sums(sums: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks (rec, .., r0, r1, c0, c1) with the mean of their cells, from four entries of the running sums each."""
    keys = [c for c in blocks.columns if c not in ("r0", "r1", "c0", "c1")]
    corner = lambda i, j, sign: F.struct((F.col(i) - 1).alias("i"), (F.col(j) - 1).alias("j"), F.lit(sign).alias("sign"))
    corners = F.array(corner("r1", "c1", 1), corner("r0", "c1", -1), corner("r1", "c0", -1), corner("r0", "c0", 1))
    area = ((F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))).alias("area")
    asked = blocks.select(*keys, area, F.explode(corners).alias("c")).select(*keys, "area", "c.i", "c.j", "c.sign")
    found = asked.join(sums, ["rec", "i", "j"], "left")  # beyond the first row or column the sum is 0
    return found.groupBy(*keys, "area").agg(F.sum(F.col("sign") * F.coalesce("s", F.lit(0.0))).alias("__s")).select(*keys, (F.col("__s") / F.col("area")).alias("mean"))


def _log_ratio(x: Column, reference: Column, share: float) -> Column:
    eps = F.greatest(F.abs(reference) * share, F.lit(1e-12))
    return F.ln((x + eps) / (reference + eps))


def closure_scores(blocks: DataFrame) -> DataFrame:
    """Log ratio of the last-to-first block to the median adjacent block, for records of three units or more."""
    size = blocks.groupBy("rec", "layer").agg((F.max("b") + 1).alias("n_units"), F.median(F.when(F.col("b") == F.col("a") + 1, F.col("mean"))).alias("adjacent"))
    ends = blocks.filter("a = 0").join(size, ["rec", "layer"]).filter("b = n_units - 1 AND n_units >= 3")
    return ends.select("rec", "layer", "n_units", F.col("mean").alias("closure"), "adjacent", (-_log_ratio(F.col("mean"), F.col("adjacent"), 1e-6)).alias("open_score"))


def boundary_candidates(blocks: DataFrame, core: DataFrame) -> DataFrame:
    """Every span of three units or more: rec, layer, a, b, open_score, is_core (it holds the core units).

    core (rec, first, last). The median of a span's adjacent blocks is taken from one sorted array per record.
    """
    edges = blocks.filter("b = a + 1").groupBy("rec", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "mean"))), lambda e: e["mean"]).alias("edges"))
    spans = blocks.filter("b >= a + 2").join(edges, ["rec", "layer"]).join(core, "rec")
    inside = F.sort_array(F.slice("edges", F.col("a") + 1, F.col("b") - F.col("a")))
    n = F.size(inside)
    median = (F.get(inside, F.floor((n - 1) / 2).cast("int")) + F.get(inside, F.floor(n / 2).cast("int"))) / 2
    scored = spans.withColumn("adjacent", median)
    return scored.select("rec", "layer", "a", "b", (-_log_ratio(F.col("mean"), F.col("adjacent"), 1e-6)).alias("open_score"), ((F.col("a") <= F.col("first")) & (F.col("b") >= F.col("last"))).alias("is_core"))


def boundary_scan(candidates: DataFrame) -> DataFrame:
    """Per record: number and low quantiles of the core spans' open scores, the least span, and the least other one."""
    core = F.when(F.col("is_core"), F.col("open_score"))
    other = F.when(~F.col("is_core"), F.col("open_score"))
    at = F.struct("open_score", "a", "b")
    return candidates.groupBy("rec", "layer").agg(
        F.count(core).alias("candidate_count"), F.min(core).alias("open_minimum"), F.percentile(core, 0.05).alias("open_q05"), F.percentile(core, 0.1).alias("open_q10"), F.median(core).alias("open_median"),
        F.min(F.when(F.col("is_core"), at)).alias("strongest"), F.count(other).alias("other_count"), F.min(other).alias("other_minimum"), F.min(F.when(~F.col("is_core"), at)).alias("other_strongest"),
    )
