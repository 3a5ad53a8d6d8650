"""Wedge operators: evidence for a period inside an interval, from diagonal tracks.

For a period p the diagonals at k p (weight 1/sqrt(k)) speak for an interval, those at
(k + 1/2) p against it. A diagonal's sum inside an interval is the difference of two
prefix sums, so every start is scored by look-ups: the offsets of the harmonics are
listed first and equi-joined, no range join runs over the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import bounded_side, materialize


def track_prefixes(tracks: DataFrame) -> DataFrame:
    """tracks (rec, sep, pos, z) -> rec, sep, n, prefix: prefix sums from 0, one array per diagonal."""
    upto = Window.partitionBy("rec", "sep").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = tracks.select("rec", "sep", "pos", F.sum(F.col("z").cast("double")).over(upto).alias("s"))
    run = F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda t: t["s"])
    return sums.groupBy("rec", "sep").agg(F.count("*").cast("int").alias("n"), F.concat(F.array(F.lit(0.0)), run).alias("prefix"))


def harmonic_offsets(templates: DataFrame, limit: str, tolerance: int = 1, harmonics: int = 8, controls: bool = True) -> DataFrame:
    """templates (.., period, limit) -> a row per (harmonic or control, separation): k, sign, weight, sep.

    Offsets lie within the tolerance of the rounded centre and in 1..limit; harmonics stop
    at the first centre beyond limit + tolerance.
    """
    ks = templates.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(harmonics)))).filter(F.col("k") * F.col("period") <= F.col(limit) + tolerance)
    sides = [F.struct(F.lit(1).alias("sign"), (F.col("k") * F.col("period")).alias("centre"))]
    if controls:
        sides.append(F.struct(F.lit(-1).alias("sign"), ((F.col("k") + 0.5) * F.col("period")).alias("centre")))
    centred = ks.withColumn("__c", F.explode(F.array(*sides))).filter(F.col("__c.centre") <= F.col(limit) + tolerance)
    mid = F.rint("__c.centre").cast("int")
    listed = F.filter(F.sequence(mid - tolerance, mid + tolerance), lambda s: (s >= 1) & (s <= F.col(limit)))
    weight = F.col("sign") / F.sqrt(F.col("k").cast("double"))
    return centred.withColumns({"sign": F.col("__c.sign"), "sep": F.explode(listed)}).withColumn("weight", weight).drop("__c")


def _summed(members: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """members (rec, *keys, length, width, sep, w, inc, v), narrow rows -> rec, *keys, start, score.

    A record's templates and its prefix arrays meet in one task, each once; a template's score
    at all starts is a weighted sum of slices. A record is bounded by its length (some
    thousand positions), and so are its arrays: positions times separations.
    """
    slots = F.array_sort(F.collect_list(F.struct("sep", "inc", "w")))
    templates = members.groupBy("rec", *keys).agg(F.any_value("length").alias("length"), F.any_value("width").alias("__width"), F.any_value("v").alias("v"), slots.alias("slots"))
    kinds = dict(templates.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in ["rec", *keys]) + ", start int, score double"

    def score(own: pa.Table, runs: pa.Table) -> pa.Table:
        prefix = dict(zip(runs.column("sep").to_pylist(), (x.values.to_numpy() for x in runs.column("prefix")), strict=True))
        taken, starts, scores = [], [], []
        columns = [own.column(c).to_pylist() for c in ("length", "__width", "v", "slots")]
        for row, (length, width, v, slots_) in enumerate(zip(*columns, strict=True)):
            n = length - width + 1
            total = np.zeros(n)
            for m in slots_:
                p = prefix[m["sep"]]
                total += m["w"] * (p[m["inc"] : m["inc"] + n] - p[:n])
            taken.append(np.full(n, row))
            starts.append(np.arange(n, dtype=np.int32))
            scores.append(total / np.sqrt(max(v, 1e-12)))
        empty = [np.zeros(0, np.int64)]
        kept = own.select(["rec", *keys]).take(pa.array(np.concatenate(taken or empty)))
        return kept.append_column("start", pa.array(np.concatenate(starts or empty), pa.int32())).append_column("score", pa.array(np.concatenate(scores or empty), pa.float64()))

    return templates.groupBy("rec").cogroup(track_prefixes(tracks).groupBy("rec")).applyInArrow(score, schema)


def start_scores(tracks: DataFrame, lengths: DataFrame, templates: DataFrame, tolerance: int = 1, harmonics: int = 8, least_harmonics: int = 2, controls: bool = True) -> DataFrame:
    """Score of every start: rec, period, width, start, score.

    lengths (rec, length); templates (period, width), a small list, or (rec, period, width); widths beyond a record
    are cut to it. Templates that keep fewer than the least number of harmonics have no rows.
    A list beyond the bound of a broadcast is an error: join it to its records instead.
    Offsets, weights and the choice of templates need the diagonals' sizes alone; their
    prefix sums come last.
    """
    sizes = materialize(tracks.groupBy("rec", "sep").agg(F.count("*").cast("int").alias("n")), "track-sizes")
    sized = lengths.join(sizes.groupBy("rec").agg(F.max("sep").alias("__most")), "rec")
    # a list meets every record; templates with a rec column are the record's own
    cut = sized.join(templates, "rec") if "rec" in templates.columns else sized.join(bounded_side(templates))
    cut = cut.select("rec", "length", "period", F.least("width", "length").alias("width"), "__most").distinct().withColumn("limit", F.least(F.col("__most"), F.col("width") - 1))
    offsets = harmonic_offsets(cut, "limit", tolerance, harmonics, controls)
    members = offsets.join(sizes, ["rec", "sep"]).filter((F.col("n") == F.col("length") - F.col("sep")) & (F.col("sep") < F.col("width")))
    group = Window.partitionBy("rec", "period", "width", "k", "sign")
    whole = Window.partitionBy("rec", "period", "width")
    each = members.withColumns({"w": F.col("weight") / F.count("*").over(group), "inc": F.col("width") - F.col("sep")})
    kept = F.size(F.collect_set(F.when(F.col("sign") == 1, F.col("k"))).over(whole))
    each = each.withColumns({"kept": kept, "v": F.sum(F.col("w") * F.col("w") * F.col("inc")).over(whole)}).filter(F.col("kept") >= least_harmonics)
    return _summed(each.select("rec", "period", "width", "length", "sep", "w", "inc", "v"), tracks, ["period", "width"])


def dense_scores(tracks: DataFrame, lengths: DataFrame, widths: DataFrame, least: int = 6, most: int | None = None) -> DataFrame:
    """The same without harmonics: all separations from ``least``; a control for mere density. rec, width, start, score."""
    sizes = materialize(tracks.groupBy("rec", "sep").agg(F.count("*").cast("int").alias("n")), "track-sizes")
    cut = lengths.join(bounded_side(widths)).select("rec", "length", F.least("width", "length").alias("width")).distinct()
    members = sizes.join(cut, "rec").filter((F.col("n") == F.col("length") - F.col("sep")) & (F.col("sep") < F.col("width")) & (F.col("sep") >= max(1, least)))
    if most is not None:
        members = members.filter(F.col("sep") <= most)
    each = members.withColumns({"inc": F.col("width") - F.col("sep"), "w": F.lit(1.0)})
    each = each.withColumn("v", F.sum("inc").over(Window.partitionBy("rec", "width")).cast("double"))
    return _summed(each.select("rec", "width", "length", "sep", "w", "inc", "v"), tracks, ["width"])


def best_interval(scores: DataFrame, period: bool = True) -> DataFrame:
    """The best start of each record; ties go to the smaller period, width, start."""
    order = ([(-F.col("period")).alias("p")] if period else []) + [(-F.col("width")).alias("w"), (-F.col("start")).alias("a")]
    best = scores.groupBy("rec").agg(F.max(F.struct("score", *order)).alias("b"))
    names = [(-F.col("b.p")).alias("period")] if period else []
    return best.select("rec", *names, (-F.col("b.w")).alias("width"), (-F.col("b.a")).alias("start"), (-F.col("b.a") - F.col("b.w")).alias("end"), F.col("b.score").alias("score"))


def residue_scores(tracks: DataFrame, lengths: DataFrame, tolerance: int = 1, harmonics: int = 8, least_harmonics: int = 2, controls: bool = True) -> DataFrame:
    """Evidence of a record's period (a column of lengths) at both endpoints of each pair: rec, pos, score."""
    top = tracks.groupBy("rec").agg(F.max("sep").alias("limit"))
    sizes = tracks.groupBy("rec", "sep").agg(F.count("*").alias("n"))
    offsets = harmonic_offsets(lengths.join(top, "rec"), "limit", tolerance, harmonics, controls)
    members = offsets.join(sizes, ["rec", "sep"]).filter(F.col("n") == F.col("length") - F.col("sep"))
    each = members.withColumn("w", F.col("weight") / F.count("*").over(Window.partitionBy("rec", "k", "sign")))
    kept = each.filter("sign = 1").groupBy("rec").agg(F.count_distinct("k").alias("kept")).filter(F.col("kept") >= least_harmonics)
    pairs = each.join(kept, "rec", "left_semi").select("rec", "sep", "w").join(tracks.select("rec", "sep", "pos", "z"), ["rec", "sep"])
    ends = pairs.select("rec", F.explode(F.array(F.col("pos"), F.col("pos") + F.col("sep"))).alias("pos"), "w", "z")
    return ends.groupBy("rec", "pos").agg((F.sum(F.col("w") * F.col("z")) / F.sqrt(F.greatest(F.sum(F.col("w") * F.col("w")), F.lit(1e-12)))).alias("score"))


def _overlap(x: Column, y: Column) -> Column:
    return F.greatest(F.lit(0), F.least(x["start"] + x["width"], y["start"] + y["width"]) - F.greatest(x["start"], y["start"]))


def distinct_loci(scores: DataFrame, top: int = 5, per_template: int = 3, apart: float = 0.5, most_overlap: float = 0.3) -> DataFrame:
    """High-scoring intervals that overlap little: rec, rank, period, width, start, score.

    A template's starts, best first, are folded into its offers: a start is an offer if it
    lies ``apart`` widths or more from those before it. A record's offers, best first (of
    equal scores the narrower, then the smaller period, then the template's own order), are
    folded likewise: an offer is taken if its share of overlap with each taken one is low.
    """
    offer = "struct<back: double, width: int, period: double, nth: int, start: int>"
    ranked = scores.groupBy("rec", "period", "width").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("back"), F.col("start").cast("int").alias("start")))).alias("starts"))
    gap = F.greatest(F.lit(1), F.rint(F.col("width") * apart).cast("int"))

    def offered(held: Column, x: Column) -> Column:
        clear = (F.size(held) < per_template) & F.forall(held, lambda h: F.abs(h["start"] - x["start"]) >= gap)
        own = F.struct(x["back"].alias("back"), F.col("width").cast("int").alias("width"), F.col("period").cast("double").alias("period"), F.size(held).alias("nth"), x["start"].alias("start"))
        return F.when(clear, F.array_append(held, own)).otherwise(held)

    offers = ranked.select("rec", F.explode(F.aggregate("starts", F.array().cast(f"array<{offer}>"), offered)).alias("o"))
    sorted_offers = offers.groupBy("rec").agg(F.array_sort(F.collect_list("o")).alias("offers"))

    def taken(held: Column, x: Column) -> Column:
        clear = (F.size(held) < top) & F.forall(held, lambda h: _overlap(h, x) <= most_overlap * (h["width"] + x["width"] - _overlap(h, x)))
        return F.when(clear, F.array_append(held, x)).otherwise(held)

    chosen = sorted_offers.select("rec", F.posexplode(F.aggregate("offers", F.array().cast(f"array<{offer}>"), taken)).alias("at", "o"))
    return chosen.select("rec", (F.col("at") + 1).alias("rank"), "o.period", "o.width", "o.start", (-F.col("o.back")).alias("score"))
