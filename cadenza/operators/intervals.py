"""Interval operators: windows, tiles, runs, smoothing, extension, overlap.

Intervals are zero-based and half-open. Everything is a Column expression or a window
over one record; no operator needs more than a record's own rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import materialize, small_side


def window_plan(records: DataFrame, sizes: tuple[int, ...] = (128, 256, 512, 1024), stride_fraction: float = 0.25, length: str = "length") -> DataFrame:
    """Explode each record into its multiscale windows: start, end, window_size.

    A size beyond the length is cut to it; the length itself is a size if it is below the
    largest; each size steps by a quarter (16 at least) and ends flush with the record.
    """
    sized = window_starts(records, sizes, stride_fraction, length)
    return sized.withColumn("start", F.explode("starts")).drop("starts").withColumn("end", F.col("start") + F.col("window_size"))


def window_starts(records: DataFrame, sizes: tuple[int, ...] = (128, 256, 512, 1024), stride_fraction: float = 0.25, length: str = "length") -> DataFrame:
    """The windows of ``window_plan`` by size: window_size, starts (ascending)."""
    n = F.col(length)
    clipped = F.array_distinct(F.array(*[F.least(n, F.lit(s)) for s in sorted(sizes)], F.when(n < max(sizes), n).otherwise(F.least(n, F.lit(sizes[-1])))))
    stride = F.greatest(F.lit(16), F.rint(F.col("window_size") * stride_fraction).cast("int"))
    last = n - F.col("window_size")
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"), stride), F.array(last.cast("int"))))
    sized = records.filter(n > 0).withColumn("window_size", F.explode(clipped)).withColumn("window_size", F.col("window_size").cast("int"))
    return sized.withColumn("starts", starts)


def tile_spans(records: DataFrame, tile: int = 128, core: int = 64, length: str = "length") -> DataFrame:
    """Tiles whose central cores cover each position once: core_start, core_end, tile_start, tile_end (unclipped)."""
    n, margin = F.col(length), (tile - core) // 2
    spans = records.filter(n > 0).withColumn("core_start", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(core))))
    return spans.withColumns(
        {"core_end": F.least(F.col("core_start") + core, n).cast("int"), "tile_start": F.col("core_start") - margin, "tile_end": F.col("core_start") - margin + tile}
    )


def periodic_tiles(records: DataFrame, least_fraction: float = 0.45) -> DataFrame:
    """records (length, period, offset) -> a row per tile: unit, start, end.

    Edges lie at offset + k period, rounded half-even, clipped to the record; tiles below
    the least fraction of a period are left out.
    """
    first = -F.ceil(F.greatest(F.col("offset"), F.lit(0.0)) / F.col("period"))
    base = F.col("offset") + first * F.col("period")
    count = F.ceil((F.col("length") - base) / F.col("period")).cast("int")
    raw = F.transform(F.sequence(F.lit(0), count), lambda k: F.rint(base + k * F.col("period")).cast("int"))
    edges = F.sort_array(F.array_distinct(F.transform(raw, lambda e: F.greatest(F.lit(0), F.least(F.col("length").cast("int"), e)))))
    pairs = F.zip_with(F.slice("__edges", 1, F.size("__edges") - 1), F.slice("__edges", 2, F.size("__edges") - 1), lambda x, y: F.struct(x.alias("start"), y.alias("end")))
    tiles = F.filter(pairs, lambda t: (t["end"] - t["start"]) >= F.lit(least_fraction) * F.col("period"))
    with_edges = records.withColumn("__edges", edges)  # not filtered here: the filter would pull the lambda below the scan
    return with_edges.select("*", F.posexplode(tiles).alias("unit", "__tile")).withColumns({"start": F.col("__tile.start"), "end": F.col("__tile.end")}).drop("__edges", "__tile")


def interval_iou(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    shared = F.greatest(F.lit(0), F.least(end1, end2) - F.greatest(start1, start2))
    union = (end1 - start1) + (end2 - start2) - shared
    return F.when(union != 0, shared.cast("double") / union).otherwise(0.0)


def expand_interval(start: Column, end: Column, period: Column, length: Column, periods_per_flank: float = 0.5) -> tuple[Column, Column]:
    """Widen symmetrically by a share of the period on each flank, inside the record."""
    width = F.greatest(F.lit(0), F.least(length, end - start))
    target = F.least(length, F.greatest(F.lit(1), F.rint(width + 2.0 * periods_per_flank * F.greatest(period, F.lit(0.0))).cast("long")))
    begin = F.rint((start + end) / 2 - target / 2).cast("long")
    begin = F.greatest(F.lit(0), F.least(begin, length - target))
    return begin, begin + target


def longest_run(rows: DataFrame, key: str, pos: str, value: str, threshold: float = 0.5) -> DataFrame:
    """The longest run of values of threshold or more, the earliest of equal ones: gaps and islands."""
    order = Window.partitionBy(key).orderBy(pos)
    hits = rows.filter(F.col(value) >= threshold).withColumn("__island", F.col(pos) - F.row_number().over(order))
    runs = hits.groupBy(key, "__island").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"))
    best = runs.groupBy(key).agg(F.max(F.struct((F.col("end") - F.col("start")).alias("length"), (-F.col("start")).alias("back"))).alias("b"))
    return best.select(key, (-F.col("b.back")).alias("run_start"), (F.col("b.length") - F.col("b.back")).alias("run_end"), F.col("b.length").alias("run_length"))


def track_summary(rows: DataFrame, key: str, pos: str, value: str, threshold: float = 0.5) -> DataFrame:
    """Mean, median, q90, supported share and longest run of each track."""
    stats = rows.groupBy(key).agg(
        F.count("*").alias("length"), F.avg(value).alias("mean"), F.median(value).alias("median"),
        F.percentile(value, 0.9).alias("q90"), F.avg((F.col(value) >= threshold).cast("double")).alias("supported_fraction"),
    )
    runs = longest_run(rows, key, pos, value, threshold)
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("run_start", "run_end", "run_length")}
    return stats.join(runs, key, "left").withColumns(zero).withColumn("run_fraction", F.col("run_length") / F.col("length"))


def labels_from_runs(length: Column, runs: Column) -> Column:
    """0/1 per position: inside any run, given as one-based inclusive (first, last)."""
    return F.transform(F.sequence(F.lit(1), length.cast("int")), lambda p: F.exists(runs, lambda r: (p >= r[0]) & (p <= r[1])).cast("int"))


def moving_average(rows: DataFrame, key: str, pos: str, value: str, width: str) -> DataFrame:
    """Centred mean over ``width`` (a column) positions, the record's ends repeated beyond its edges.

    Prefix sums are joined at two positions, so the width may differ by record.
    """
    order = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    by_pos = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.least(F.col(width), F.col("__n")).cast("int")
    pre = rows.withColumns({"__n": F.count("*").over(whole), "__sum": F.sum(value).over(order), "__first": F.first(value).over(by_pos), "__last": F.last(value).over(by_pos)})
    left = w.bitwiseAND(F.lit(-1)) - F.ceil(w / 2).cast("int")  # w // 2
    pre = pre.withColumns({"__w": w, "__a": F.col(pos) - left, "__b": F.col(pos) + (w - 1 - left)})
    sums = pre.select(F.col(key).alias("__k"), F.col(pos).alias("__p"), F.col("__sum").alias("__s"))
    low, high = sums.toDF("__k1", "__p1", "__s1"), sums.toDF("__k2", "__p2", "__s2")
    joined = pre.join(low, (F.col(key) == F.col("__k1")) & (F.greatest(F.col("__a"), F.lit(0)) - 1 == F.col("__p1")), "left").join(
        high, (F.col(key) == F.col("__k2")) & (F.least(F.col("__b"), F.col("__n") - 1) == F.col("__p2"))
    )
    beyond = F.greatest(-F.col("__a"), F.lit(0)) * F.col("__first") + F.greatest(F.col("__b") - F.col("__n") + 1, F.lit(0)) * F.col("__last")
    smooth = (F.col("__s2") - F.coalesce(F.col("__s1"), F.lit(0)) + beyond) / F.col("__w")
    return joined.withColumn("smooth", smooth).select(*rows.columns, "smooth")


def stopping_extension(values: Column, patience: Column) -> Column:
    """Struct (steps, inspected): the best positive prefix before ``patience`` losses in a row. values: array ordered outward."""
    start = F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in (("sum", 0.0, "double"), ("best", 0.0, "double"), ("steps", 0, "int"), ("losses", 0, "int"), ("seen", 0, "int"), ("over", False, "boolean"))])

    def step(s: Column, v: Column) -> Column:
        total, seen = s["sum"] + v, s["seen"] + 1
        better = total > s["best"]
        losses = F.when(v > 0, F.lit(0)).otherwise(s["losses"] + 1)
        moved = F.struct(total.alias("sum"), F.when(better, total).otherwise(s["best"]).alias("best"), F.when(better, seen).otherwise(s["steps"]).alias("steps"), losses.alias("losses"), seen.alias("seen"), (losses >= patience).alias("over"))
        return F.when(s["over"], s).otherwise(moved)

    return F.aggregate(values, start, step, lambda s: F.struct(s["steps"].alias("steps"), s["seen"].alias("inspected")))


def _runs(histogram: list[tuple[int, int]], budget: int, most: int, padding: int) -> list[tuple[int, int, int, int]]:
    """(length, n) in ascending order -> (length, first, size, batch): from its place ``first`` on, records of a length fill batches of ``size``, the first of them ``batch``."""
    out, batch, held = [], -1, 0
    for length, n in histogram:
        room = min(most, budget // (length + padding) ** 2)
        joined = min(n, max(0, room - held)) if held else 0
        if joined:
            out.append((length, 0, joined, batch))
            held += joined
        if n > joined:
            size = max(1, room)
            out.append((length, joined, size, batch + 1))
            new = -(-(n - joined) // size)
            batch, held = batch + new, n - joined - (new - 1) * size
    return out


def greedy_batches(records: DataFrame, budget: int = 4_000_000, most: int = 64, padding: int = 2) -> DataFrame:
    """records (record_id, length) -> record_id, length, batch: one global (length, record_id) order, a batch closed
    when it holds ``most`` records or its padded square cost would pass the budget.

    In that order the cost hangs on the last length alone, so records of one length fill
    batches of one size: the sequential part is a fold over the counts of lengths (as many
    rows as the longest record is long, at most). A record's place among those of its
    length comes from range partitions and their row counts.
    """
    spark = records.sparkSession
    order = Window.partitionBy("__part").orderBy("length", "record_id")
    spread = records.select("record_id", "length").repartitionByRange("length", "record_id").withColumn("__part", F.spark_partition_id())
    spread = materialize(spread.withColumn("__nth", F.row_number().over(order) - 1), "batch-places")
    counts = spread.groupBy("__part", "length").agg(F.count("*").alias("n"), F.min("__nth").alias("__least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select("__part", "length", "n", (before - F.col("__least")).alias("__shift")), "batch-starts")
    histogram = starts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()
    runs = spark.createDataFrame(_runs([(r.length, r.n) for r in histogram], budget, most, padding), "length int, __first long, __size long, __batch long")
    placed = spread.join(small_side(starts.drop("n")), ["__part", "length"]).withColumn("__at", F.col("__nth") + F.col("__shift"))
    last = runs.withColumn("__end", F.coalesce(F.lead("__first").over(Window.partitionBy("length").orderBy("__first")), F.lit(2**62)))
    found = placed.join(small_side(last), "length").filter((F.col("__at") >= F.col("__first")) & (F.col("__at") < F.col("__end")))
    return found.select("record_id", "length", (F.col("__batch") + F.floor((F.col("__at") - F.col("__first")) / F.col("__size"))).alias("batch"))


def candidate_periods(windows: DataFrame, key: str, least_size: int = 96, top: int = 8, aliases: tuple[float, ...] = (0.5, 1.0, 2.0), low: float = 5.0, high: float = 80.0, step: float = 0.5) -> DataFrame:
    """windows (key, window_size, start, end, score, n_harmonics, period) -> key, period: aliases of the strongest windows' periods."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("n_harmonics"), "window_size", "start", "end")
    best = windows.filter((F.col("window_size") >= least_size) & (F.col("period") > 0)).withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= top)
    alias = best.select(key, F.explode(F.array(*[F.lit(a) for a in aliases])).alias("m"), "period")
    rounded = F.rint(F.col("period") * F.col("m") / F.lit(step)) * F.lit(step)
    return alias.select(key, rounded.alias("period")).filter(F.col("period").between(low, high)).distinct()


def upper_tail_pvalue(rows: DataFrame, key: str, observed: str, null: str) -> DataFrame:
    """(1 + nulls at or above the observed) / (nulls + 1), per key."""
    return rows.groupBy(key).agg(((F.count_if(F.col(null) >= F.col(observed)) + 1) / (F.count("*") + 1)).alias("p_value"))
