"""Queries that transform signals, register units, extend intervals, and the whole decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import calibration as cal
from cadenza.functions import spectral as sp
from cadenza.operators import intervals as iv
from cadenza.operators import registration as rg
from cadenza.operators import spectra as spx
from cadenza.operators import wedge as wg
from cadenza.plans import inputs, topology
from cadenza.plans import matrix_queries as mq
from cadenza.plans.inputs import HOURLY_SQL
from cadenza.session import bounded_batches, materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SIZES = (64, 96)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.window_plan(mq.lengths(spark, sf_dir), _SIZES).drop("length")


_SPECTRUM_SQL = f"""{HOURLY_SQL}, m AS (SELECT *, count(*) OVER w AS len, avg(n) OVER w AS mean, regr_slope(n, hour) OVER w AS slope, avg(hour) OVER w AS mid FROM hourly WINDOW w AS (PARTITION BY event_type)),
d AS (SELECT event_type, hour, len, (n - mean) - slope * (hour - mid) AS x FROM m), sd AS (SELECT event_type, stddev_pop(x) AS sd FROM d GROUP BY 1),
t AS (SELECT event_type, hour, len, 0.5 - 0.5 * cos(2 * pi() * hour / (len - 1)) AS taper, x / sd AS x FROM d JOIN sd USING (event_type)),
f AS (SELECT event_type, len, b, sum(x * taper * cos(2 * pi() * ((b * hour) % len) / len)) AS re, sum(x * taper * sin(2 * pi() * ((b * hour) % len) / len)) AS im, sum(taper * taper) AS norm
      FROM (SELECT *, unnest(range(0, len // 2 + 1)) AS b FROM t) GROUP BY 1, 2, 3),
l AS (SELECT event_type, b, len // 2 AS most, ln(1 + (re * re + im * im) / norm) AS level FROM f),
o AS (SELECT *, least(15, greatest(5, ((most + 1) // 8) | 1)) // 2 AS side FROM l),
k AS (SELECT event_type, b, greatest(0, least(most, b + unnest(range(-side, side + 1)))) AS at FROM o),
r AS (SELECT l.event_type, l.b, l.level - base AS x FROM l JOIN (SELECT k.event_type, k.b, median(l.level) AS base FROM k JOIN l ON l.event_type = k.event_type AND l.b = k.at GROUP BY 1, 2) USING (event_type, b)),
c AS (SELECT event_type, median(x) AS mid FROM r WHERE b >= 2 GROUP BY 1), v AS (SELECT r.event_type, mid, 1.4826 * median(abs(x - mid)) AS scale FROM r JOIN c USING (event_type) WHERE b >= 2 GROUP BY 1, 2)"""


@query(f"WITH {_SPECTRUM_SQL} SELECT event_type, round(scale, 6) AS scale, b::INT AS bin, round((x - mid) / scale, 5) + 0.0 AS z FROM r JOIN v USING (event_type)")
def spectrum_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = inputs.hourly(spark, sf_dir).groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "n"))), lambda t: t["n"].cast("double")).alias("xs"))
    spectra = own.withColumn("s", sp.signal_spectrum(F.col("xs")))
    return spectra.select("event_type", F.round("s.scale", 6).alias("scale"), F.posexplode("s.z").alias("bin", "z")).withColumn("z", F.round("z", 5) + 0.0)


_COMB = """c AS (SELECT l_suppkey AS rec, l_quantity::INT AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
g0 AS (SELECT rec, b FROM (SELECT DISTINCT rec FROM c), (SELECT unnest(range(0, 65)) AS b)),
z AS (SELECT g0.rec, list(coalesce(n, 0) / 4.0::DOUBLE - 1 ORDER BY b) AS z FROM g0 LEFT JOIN c ON c.rec = g0.rec AND c.q = b GROUP BY g0.rec),
f AS (SELECT rec, z, unnest(range(3, 26))::INT AS b FROM z), g AS (SELECT *, least(8, 64 // b)::INT AS nt FROM f WHERE 64 // b >= 2),
h AS (SELECT rec, b, nt, unnest(range(1, nt + 1)) AS k, z FROM g), p AS (SELECT rec, b, nt, k, list_max(z[greatest(1, k * b - 1) + 1 : least(64, k * b + 1) + 1]) AS v FROM h),
s AS (SELECT rec, b, any_value(nt) AS nt, round(sum(greatest(0, v - 1) / sqrt(k::DOUBLE) ORDER BY k) / sqrt(sum(1 / k::DOUBLE ORDER BY k)), 9) AS score, count(*) FILTER (v >= 2.5) AS ns FROM p GROUP BY rec, b),
r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY score DESC, ns DESC, b) AS q FROM s)"""


@query(f"WITH {_COMB} SELECT rec, round(score, 6) AS score, ns::INT AS n_significant FROM r WHERE q = 1")
def harmonic_comb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combs over the suppliers' histograms of quantities, a bin per quantity."""
    rec = F.col("l_suppkey")
    counts = table(spark, sf_dir, "lineitem").groupBy(rec, F.col("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("n"))
    own = counts.groupBy(rec).agg(F.map_from_entries(F.collect_list(F.struct("q", "n"))).alias("m"))
    own = own.withColumn("z", F.transform(F.sequence(F.lit(0), F.lit(64)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)) / 4.0 - 1))
    call = own.select(rec.alias("rec"), sp.comb(F.col("z"), F.lit(128), 5.0, 128 / 3).alias("c"))
    return call.select("rec", F.round(F.round("c.score", 9), 6).alias("score"), F.col("c.n_significant").alias("n_significant"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(inputs.sequences(spark, sf_dir).select("record_id", "sequence"), "sequences")


@query()
def repetita(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude features of every whole sequence."""
    rows = _sequences(spark, sf_dir).filter(F.length("sequence") > 0)
    return rows.select("record_id", sp.amplitude_features(F.col("sequence")).alias("r")).select("record_id", "r.*")


#: Letters whose windows one task scores; their scores are some sixteen times the work of a plain pass.
LETTERS_PER_TASK = 1 << 20


@query()
def scan_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all multiscale windows of every whole sequence."""
    bounded_batches(spark, workers=False)
    rows = _sequences(spark, sf_dir)
    letters = rows.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0))).first()[0]
    out = spx.scan_sequences(rows.repartition(1 + letters // LETTERS_PER_TASK))
    return out.select("record_id", "start", "end", F.col("physical.score").alias("physical_score"), F.col("physical.period").alias("physical_period"), F.col("factor_max.factor").alias("factor"), F.col("exact.score").alias("exact_score"), F.col("repetita.zmax").alias("zmax"))


def _local_sql() -> str:
    return ", ".join(f"({k}, {', '.join(f'({c!r})::DOUBLE' for c in (*v['coefficients'], v['mean'], v['sd']))})" for k, v in cal.LOCAL.items())


_LARGEST = max(_SIZES)
#: Spectra of the windows' diagonal profiles by sums of cosines, their combs, and the layers' calibrated scores.
_FUSED_SQL = f"""{mq.APC}, sz AS (SELECT rec, length, unnest(list_distinct([{', '.join(f'least(length, {n})' for n in _SIZES)}, CASE WHEN length < {_LARGEST} THEN length ELSE least(length, {_SIZES[-1]}) END]))::INT AS w FROM lens),
wd AS (SELECT DISTINCT rec, length, w, unnest(list_append(range(0, length - w + 1, greatest(16, round_even(w * 0.25, 0)::INT)), length - w))::INT AS s FROM sz),
pf AS (SELECT wd.rec, layer, length, w, s, j - i - 1 AS k, w - 1 AS n, avg(v) AS x FROM wd JOIN mat ON mat.rec = wd.rec AND i >= s AND j < s + w AND j > i GROUP BY ALL),
no AS (SELECT *, unnest(range(-sd, sd + 1)) AS d FROM (SELECT *, greatest(5, least(31, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END)) // 2 AS sd FROM pf)),
md AS (SELECT o.rec, o.layer, o.w, o.s, o.k, median(p.x) AS base FROM no o JOIN pf p ON p.rec = o.rec AND p.layer = o.layer AND p.w = o.w AND p.s = o.s AND p.k = greatest(0, least(o.n - 1, o.k + o.d)) GROUP BY ALL),
rz AS (SELECT pf.* EXCLUDE (x), x - base AS x FROM pf JOIN md USING (rec, layer, w, s, k)),
dt AS (SELECT *, (x - avg(x) OVER g) - regr_slope(x, k) OVER g * (k - avg(k) OVER g) AS y FROM rz WINDOW g AS (PARTITION BY rec, layer, w, s)),
tp AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * k / (n - 1)) AS taper, y / stddev_pop(y) OVER (PARTITION BY rec, layer, w, s) AS u FROM dt),
ft AS (SELECT rec, layer, length, w, s, n, b, sum(u * taper * cos(2 * pi() * ((b * k) % n) / n)) AS re, sum(u * taper * sin(2 * pi() * ((b * k) % n) / n)) AS im, sum(taper * taper) AS norm
       FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS b FROM tp) GROUP BY ALL),
lv AS (SELECT rec, layer, length, w, s, n, b, n // 2 AS most, ln(1 + (re * re + im * im) / norm) AS y FROM ft),
nb AS (SELECT *, unnest(range(-sd, sd + 1)) AS d FROM (SELECT *, least(15, greatest(5, ((most + 1) // 8) | 1)) // 2 AS sd FROM lv)),
mb AS (SELECT o.rec, o.layer, o.w, o.s, o.b, median(p.y) AS base FROM nb o JOIN lv p ON p.rec = o.rec AND p.layer = o.layer AND p.w = o.w AND p.s = o.s AND p.b = greatest(0, least(o.most, o.b + o.d)) GROUP BY ALL),
lf AS (SELECT lv.*, y - base AS x FROM lv JOIN mb USING (rec, layer, w, s, b)),
c1 AS (SELECT rec, layer, w, s, median(x) AS mid FROM lf WHERE b >= 2 GROUP BY ALL), c2 AS (SELECT lf.rec, lf.layer, lf.w, lf.s, any_value(mid) AS mid, 1.4826 * median(abs(x - mid)) AS scale FROM lf JOIN c1 USING (rec, layer, w, s) WHERE b >= 2 GROUP BY ALL),
zs AS (SELECT rec, layer, length, w, s, n, most, list((x - mid) / scale ORDER BY b) AS z FROM lf JOIN c2 USING (rec, layer, w, s) GROUP BY ALL),
fb AS (SELECT *, unnest(range(greatest(3, ceil(n / least(250, n / 3.0::DOUBLE))::INT), least(most, floor(n / 5.0::DOUBLE)::INT) + 1)) AS b FROM zs),
fk AS (SELECT *, unnest(range(1, least(8, most // b) + 1)) AS k FROM fb WHERE most // b >= 2),
pk AS (SELECT rec, layer, length, w, s, n, b, k, list_max(z[greatest(1, k * b - 1) + 1 : least(most, k * b + 1) + 1]) AS v FROM fk),
sc AS (SELECT rec, layer, length, w, s, n, b, round(sum(greatest(0, v - 1) / sqrt(k::DOUBLE)) / sqrt(sum(1 / k::DOUBLE)), 9) AS score, count(*) FILTER (v >= 2.5) AS hits FROM pk GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY rec, layer, w, s ORDER BY score DESC, hits DESC, b) AS q FROM sc),
lc(layer, a0, a1, a2, mu, sd) AS (VALUES {_local_sql()}),
zz AS (SELECT rec, layer, w, s, n / b AS period, hits, (ln(1 + score) - (a0 + a1 * log2(w) + a2 * log2(length)) - mu) / sd AS z FROM bs JOIN lc USING (layer) WHERE q = 1)"""


@query(f"""WITH {_FUSED_SQL} SELECT rec, s AS start, s + w AS "end", w AS window_size, round(avg(z), 5) AS score, round(arg_max(period, z), 6) AS period, arg_max(hits, z)::INT AS n_harmonics, arg_max(layer, z)::INT AS source_layer,
  round(max(z) FILTER (layer = 13), 5) AS z13, round(max(z) FILTER (layer = 35), 5) AS z35 FROM zz GROUP BY rec, s, w""")
def fused_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spx.fused_windows(spx.score_profiles(spx.window_profiles(mq.matrix(spark, sf_dir), _windows(spark, sf_dir))), mq.lengths(spark, sf_dir))
    layers = [F.round(F.element_at("layer_residual_z", F.lit(str(k))), 5).alias(f"z{k}") for k in cal.LAYERS]
    return out.select("rec", "start", "end", "window_size", F.round("score", 5).alias("score"), F.round("period", 6).alias("period"), "n_harmonics", "source_layer", *layers)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed call per record, the middle half at period 11.5."""
    quarter = F.floor(F.col("length") / 4).cast("int")
    return mq.lengths(spark, sf_dir).select("rec", "length", F.lit(11.5).alias("period"), quarter.alias("start"), (F.col("length") - quarter).alias("end"))


@query()
def register_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.register_units(mq.matrix(spark, sf_dir).filter("layer = 35"), _calls(spark, sf_dir))


def _residue_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(wg.residue_scores(mq.fused(spark, sf_dir), mq.lengths(spark, sf_dir).withColumn("period", F.lit(11.5))), "residue-scores")


_RESIDUE_SQL = f"""{mq.RESIDUES}, cl AS (SELECT rec, length, length // 4 AS c0, length - length // 4 AS c1, length - 2 * (length // 4) AS cw FROM lens),
hr AS (SELECT h.rec, h.pos::INT AS pos, h.score, l.length FROM hr0 h JOIN lens l USING (rec)),
xo AS (SELECT rec, pos, greatest(0, least(length - 1, pos - 6 + unnest(range(0, 12)))) AS at FROM hr),
sm AS (SELECT xo.rec, xo.pos, avg(h.score) AS x FROM xo JOIN hr h ON h.rec = xo.rec AND h.pos = xo.at GROUP BY 1, 2),
sd AS (SELECT cl.*, greatest(0, least(round_even((c0 + c1) / 2.0::DOUBLE - w / 2.0::DOUBLE, 0)::BIGINT, length - w)) AS s0, w FROM (SELECT *, least(length, greatest(1, round_even(cw + 11.5, 0)::BIGINT)) AS w FROM cl) cl),
rf AS (SELECT sm.rec, any_value(length) AS length, any_value(s0) AS s0, any_value(s0 + w) AS s1, any_value(c0) AS c0, any_value(c1) AS c1, quantile_cont(x, 0.4) AS base, quantile_cont(x, 0.75) FILTER (pos >= c0 AND pos < c1) AS ref FROM sm JOIN sd USING (rec) GROUP BY sm.rec),
th AS (SELECT *, base + 0.2 * (ref - base) AS thr FROM rf),
st AS (SELECT th.rec, 'l' AS side, s0 - pos AS k, x - thr AS a FROM sm JOIN th USING (rec) WHERE pos < s0 AND ref > base UNION ALL SELECT th.rec, 'r', pos - s1 + 1, x - thr FROM sm JOIN th USING (rec) WHERE pos >= s1 AND ref > base)"""
_EXTENDED = ("left_steps", "right_steps", "left_inspected", "right_inspected", "seed_start", "seed_end")
_EXTENDED_SQL = """SELECT th.rec, (s0 - coalesce(l.steps, 0))::INT AS start, (s1 + coalesce(r.steps, 0))::INT AS "end", coalesce(l.steps, 0)::INT AS left_steps, coalesce(r.steps, 0)::INT AS right_steps,
  coalesce(l.seen, 0)::INT AS left_inspected, coalesce(r.seen, 0)::INT AS right_inspected, s0::INT AS seed_start, s1::INT AS seed_end, round(base, 6) AS residue_baseline, round(ref, 6) AS residue_core_reference, round(thr, 6) AS residue_threshold
  FROM th LEFT JOIN ex l ON l.rec = th.rec AND l.side = 'l' LEFT JOIN ex r ON r.rec = th.rec AND r.side = 'r'"""


def _extended(out: DataFrame) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("residue_baseline", "residue_core_reference", "residue_threshold")]
    return out.select("rec", *[F.col(c).cast("int").alias(c) for c in ("start", "end", *_EXTENDED)], *rounded)


@query(f"""WITH {_RESIDUE_SQL}, cu AS (SELECT rec, side, k, sum(a) OVER (PARTITION BY rec, side ORDER BY k) AS total FROM st),
bs AS (SELECT rec, side, max(total) AS top, max(k) AS seen FROM cu GROUP BY 1, 2), ex AS (SELECT rec, side, seen, CASE WHEN top > 0 THEN min(k) FILTER (total = top) ELSE 0 END AS steps FROM cu JOIN bs USING (rec, side) GROUP BY rec, side, seen, top)
{_EXTENDED_SQL}""")
def extend_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(rg.extend_intervals(_calls(spark, sf_dir), _residue_scores(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_RESIDUE_SQL}, lm AS (SELECT * FROM st WHERE k <= 46),
wk AS (SELECT rec, side, k, a AS total, greatest(a, 0) AS best, CASE WHEN a > 0 THEN 1 ELSE 0 END AS steps, CASE WHEN a > 0 THEN 0 ELSE 1 END AS losses FROM lm WHERE k = 1
  UNION ALL SELECT w.rec, w.side, l.k, w.total + l.a, greatest(w.best, w.total + l.a), CASE WHEN w.total + l.a > w.best THEN l.k ELSE w.steps END, CASE WHEN l.a > 0 THEN 0 ELSE w.losses + 1 END
  FROM wk w JOIN lm l ON l.rec = w.rec AND l.side = w.side AND l.k = w.k + 1 WHERE w.losses < 12),
ex AS (SELECT rec, side, arg_max(steps, k) AS steps, max(k) AS seen FROM wk GROUP BY 1, 2)
{_EXTENDED_SQL}""")
def extend_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(rg.extend_intervals(_calls(spark, sf_dir), _residue_scores(spark, sf_dir), patience_periods=1.0, extra_periods=4.0))


#: Half precision: 11 significant bits, steps of 2^-24 below 2^-14, halves to even.
_HALF_STEP = "pow(2::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10)"


@query(f"""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT vec_id, pos::INT AS pos, CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / {_HALF_STEP}, 0) * {_HALF_STEP} END + 0.0 AS half FROM v""")
def fp16_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(sp.half_precision(F.col("embedding"))).alias("pos", "half"))
    return halves.select("vec_id", "pos", F.col("half").cast("double") + 0.0).toDF("vec_id", "pos", "half")


@query()
def topology_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.decode(mq.matrix(spark, sf_dir), mq.lengths(spark, sf_dir), _SIZES, tuple(mq.WIDTHS), least_size=64)
