"""Queries over masked and tiled affinity matrices, and over maps of layer scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import calibration as cal
from cadenza.operators import matrices as mx
from cadenza.operators import tiles as tl
from cadenza.operators.intervals import track_summary
from cadenza.plans import matrix_queries as mq
from cadenza.plans.sequence_queries import LAYERS_SQL, layers, spectrum_sql
from cadenza.session import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions are special or unattended by their own first two values."""
    return mq.residues(spark, sf_dir).select("rec", "i", (F.pmod(F.get("x", F.lit(0)), F.lit(7)) == 0).alias("special"), (F.pmod(F.get("x", F.lit(1)), F.lit(5)) != 0).alias("attended"))


_MODULO = "((({x})::BIGINT % {m}) + {m}) % {m}"
_MASK_SQL = f"""kp AS (SELECT rec, i, (row_number() OVER (PARTITION BY rec ORDER BY i) - 1)::INT AS place FROM res
  WHERE {_MODULO.format(x='x[1]', m=7)} <> 0 AND {_MODULO.format(x='x[2]', m=5)} <> 0)"""


@query(f"""WITH {mq.CELLS}, {_MASK_SQL}, cc AS (SELECT c.rec, c.layer, c.head, a.place AS i, b.place AS j, c.v FROM cells c JOIN kp a ON a.rec = c.rec AND a.i = c.i JOIN kp b ON b.rec = c.rec AND b.i = c.j),
rs AS (SELECT rec, layer, head, i, sum(v) AS s FROM cc GROUP BY ALL), ts AS (SELECT rec, layer, head, sum(s) AS t FROM rs GROUP BY ALL)
SELECT c.rec, c.layer, c.i, c.j, floor(CASE WHEN abs(c.i - c.j) < 6 THEN 0.0 ELSE avg(greatest(0.0, c.v - r.s * q.s / (t.t + 1e-12::DOUBLE))) END * 1000)::BIGINT AS v FROM cc c
  JOIN rs r ON r.rec = c.rec AND r.layer = c.layer AND r.head = c.head AND r.i = c.i JOIN rs q ON q.rec = c.rec AND q.layer = c.layer AND q.head = c.head AND q.i = c.j
  JOIN ts t ON t.rec = c.rec AND t.layer = c.layer AND t.head = c.head GROUP BY c.rec, c.layer, c.i, c.j""")
def apc_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected matrices of the kept positions alone, under their new numbers."""
    kept = materialize(mx.kept_positions(_mask(spark, sf_dir)), "kept")
    return mx.apc_head_mean(mq.cells(spark, sf_dir), positions=kept).withColumn("v", F.floor(F.col("v") * 1000))


CLASSES = ["bent", "coiled", "open"]


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a tile model stand in: tiles of a record hold the values of its embeddings on and beside their diagonal, and padding holds large ones."""
    own = mq.residues(spark, sf_dir).select("rec", "i", F.transform(F.slice("x", 1, 1 + len(CLASSES)), lambda v: v / 64.0).alias("x"))
    cores = mq.lengths(spark, sf_dir).select("rec", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(tl.CORE))).alias("core_start"))
    places = cores.withColumn("ti", F.explode(F.sequence(F.lit(0), F.lit(tl.TILE - 1)))).withColumn("i", F.col("core_start") + F.col("ti") - (tl.TILE - tl.CORE) // 2)
    filled = places.join(own, ["rec", "i"], "left").withColumn("x", F.coalesce("x", F.array(*[F.lit(99.0)] * (1 + len(CLASSES)))))
    beside = filled.select("rec", "core_start", "ti", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"), F.posexplode("x").alias("channel", "v"))
    cells = beside.select("rec", "core_start", "channel", "ti", (F.col("ti") + F.col("d")).alias("tj"), (F.col("v") + 5 * F.col("d")).alias("logit"))
    return cells.filter(F.col("tj").between(0, tl.TILE - 1))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.decode_tiles(_logits(spark, sf_dir), mq.lengths(spark, sf_dir), CLASSES)


def _sigmoid_sql(x: str) -> str:
    return f"1 / (1 + exp(-({x})))"


_TRACK = f"""{mq.CELLS}, lg AS (SELECT rec, i AS pos, list_transform(x[1:{1 + len(CLASSES)}], lambda v: v / 64.0::DOUBLE) AS x FROM res),
ex AS (SELECT rec, pos, {_sigmoid_sql('x[1]')} AS state, list_transform(x[2:], lambda v: exp(v - list_max(x[2:]))) AS e FROM lg),
tk AS (SELECT rec, pos, state, {', '.join(f"e[{k}] / list_sum(e) AS p_{c}" for k, c in enumerate(CLASSES, 1))} FROM ex)"""


@query(f"WITH {_TRACK} SELECT rec, pos, round(state, 8) AS state, {', '.join(f'round(p_{c}, 8) AS p_{c}' for c in CLASSES)} FROM tk")
def tile_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles' outputs as one track of the state and one of each class."""
    return _decoded(spark, sf_dir).select("rec", "pos", F.round("state", 8).alias("state"), *[F.round(F.element_at("classes", F.lit(c)), 8).alias(f"p_{c}") for c in CLASSES])


@query(f"""WITH {_TRACK}, m AS (SELECT rec, round(avg(state), 8) AS mean, round(median(state), 8) AS median, round(quantile_cont(state, 0.9), 8) AS q90, round(avg((state >= 0.5)::INT), 8) AS supported_fraction,
  {', '.join(f"avg(p_{c}) AS {c}" for c in CLASSES)} FROM tk GROUP BY rec)
SELECT rec, mean, median, q90, supported_fraction, name, round(p, 8) AS mean_probability FROM (UNPIVOT m ON {', '.join(CLASSES)} INTO NAME name VALUE p)""")
def tile_class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's state summary, and its map of class means opened."""
    track = materialize(_decoded(spark, sf_dir), "decoded")
    summary = track_summary(track, "rec", "pos", "state").select("rec", *[F.round(c, 8).alias(c) for c in ("mean", "median", "q90", "supported_fraction")])
    return summary.join(tl.class_means(track), "rec").select(*summary.columns, F.explode("class_means").alias("name", "p")).select(*summary.columns, "name", F.round("p", 8).alias("mean_probability"))


@query(f"""WITH {mq.APC}, s AS (SELECT rec, layer, quantile_cont(v, 0.95) AS s FROM mat WHERE v > 0 GROUP BY ALL),
ch AS (SELECT rec, (layer = 35)::INT AS channel, i, j, CASE WHEN s > 0 THEN least(greatest(ln(1 + v / s), 0), ln(9.0::DOUBLE)) / ln(9.0::DOUBLE) ELSE 0.0 END AS c FROM mat LEFT JOIN s USING (rec, layer)
       UNION ALL SELECT rec, 2, i, j, 1.0 FROM mat WHERE layer = 13),
sp AS (SELECT rec, unnest(range(0, length, {tl.CORE}))::INT AS core_start FROM lens), full_ AS (SELECT rec, core_start, unnest(range(0, 3))::INT AS channel FROM sp),
cl AS (SELECT ch.rec, core_start, channel, i - core_start + 32 AS ti, j - core_start + 32 AS tj, floor(c::FLOAT::DOUBLE * 100000 + 0.5)::BIGINT AS q FROM ch JOIN sp ON sp.rec = ch.rec
  WHERE i - core_start + 32 BETWEEN 0 AND 127 AND j - core_start + 32 BETWEEN 0 AND 127)
SELECT rec, core_start, channel, 16384 AS cells, count(*) FILTER (q > 0) AS filled, coalesce(sum(q), 0)::BIGINT AS total, coalesce(sum(q * (ti * 128 + tj)), 0)::BIGINT AS moment
FROM full_ LEFT JOIN cl USING (rec, core_start, channel) GROUP BY rec, core_start, channel""")
def dense_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense tiles of both layers and their validity channel, as sums of each channel's values and places."""
    channels = tl.attention_channels(mq.matrix(spark, sf_dir))
    tiles = tl.dense_tiles(channels, mq.lengths(spark, sf_dir), 2).select("rec", "core_start", F.posexplode("tile").alias("channel", "v"))
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * 100_000 + 0.5))
    sums = tiles.select("rec", "core_start", "channel", whole.alias("q"))
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    moment = F.transform("q", lambda x, k: x * k)
    return sums.select("rec", "core_start", "channel", F.size("q").alias("cells"), F.size(F.filter("q", lambda x: x > 0)).cast("long").alias("filled"), total(F.col("q")).alias("total"), total(moment).alias("moment"))


_VALUES = ("raw_score", "log_score", "expected_control_log_score", "length_residual", "length_residual_z")


@query(f"""WITH {LAYERS_SQL}, {spectrum_sql()}, l AS (SELECT record, layer, score AS raw_score, ln(1 + score) AS log_score, slope * log2(length) + icpt AS expected_control_log_score, mu, sd FROM feats JOIN k USING (layer)),
r AS (SELECT *, log_score - expected_control_log_score AS length_residual FROM l), z AS (SELECT *, (length_residual - mu) / sd AS length_residual_z FROM r)
SELECT record, layer::VARCHAR AS layer, {', '.join(f'round({v}, 8) AS {v}' for v in _VALUES)}, round(spectrum_score, 8) AS score FROM z JOIN spec USING (record)""")
def layer_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested spectrum of each record, its map of layers opened."""
    own = layers(spark, sf_dir).groupBy("record").agg(F.first("length").alias("length"), F.collect_list(F.struct("layer", "score")).alias("f"))
    spectra = own.select("record", cal.frozen_spectrum(cal.layer_score_map(F.col("f")), F.col("length")).alias("s"))
    opened = spectra.select("record", F.explode("s.layers").alias("layer", "v"), F.col("s.score").alias("score"))
    rounded: list[Column] = [F.round(F.col(f"v.{v}"), 8).alias(v) for v in _VALUES]
    return opened.select("record", "layer", *rounded, F.round("score", 8).alias("score"))
