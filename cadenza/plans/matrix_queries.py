"""Queries over affinity matrices, tracks and units.

Records are blocks of 96 embeddings; layers 13 and 35 are the two halves of the vectors
with two heads each; a cell is the product of two quantised vectors, cut at zero. So the
number of records grows with the table and their length doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators import intervals as iv
from cadenza.operators import matrices as mx
from cadenza.operators import wedge as wg
from cadenza.session import materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
BLOCK = 96
#: All diagonals of a record.
MOST = BLOCK - 1
PERIODS, WIDTHS = [8.0, 11.5, 14.0, 30.0], [40, 64, 128]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, i, x (64 integers)."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / BLOCK).cast("long").alias("rec"), "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("x"))
    return rows.select("rec", (F.row_number().over(Window.partitionBy("rec").orderBy("vec_id")) - 1).alias("i"), "x")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residues(spark, sf_dir).groupBy("rec").agg(F.count("*").cast("int").alias("length"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = residues(spark, sf_dir).select("rec", "i", "x", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("h"))
    cut = heads.select("rec", "i", "h", F.slice("x", F.col("h") * 16 + 1, 16).alias("x"))
    a, b = cut, cut.select("rec", "h", F.col("i").alias("j"), F.col("x").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    pairs = a.join(b, ["rec", "h"])  # the cells of one matrix: at most 96 by 96
    return pairs.select("rec", F.when(F.col("h") < 2, 13).otherwise(35).alias("layer"), (F.col("h") % 2).alias("head"), "i", "j", F.greatest(F.lit(0.0), dot).alias("v"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, layer, i, j, v: whole numbers. Written once, as most queries read it in several branches."""
    return materialize(mx.apc_head_mean(cells(spark, sf_dir)).withColumn("v", F.floor("v").cast("double")), "matrix")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, layer, sep, pos, z: thousandths, whole numbers."""
    return mx.diagonal_tracks(matrix(spark, sf_dir), MOST).withColumn("z", F.floor(F.col("z") * 1000))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(mx.fuse_tracks(tracks(spark, sf_dir)).withColumn("z", F.floor("z").cast("double")), "tracks")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, w) for p in PERIODS for w in WIDTHS], "period double, width int")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = iv.periodic_tiles(lengths(spark, sf_dir).withColumns({"period": F.lit(12.0), "offset": F.lit(5.0)}))
    order = Window.partitionBy("rec").orderBy("start")
    return tiles.select("rec", (F.row_number().over(order) - 1).alias("unit"), "start", "end")


CELLS = f"""res AS (SELECT vec_id // {BLOCK} AS rec, (row_number() OVER (PARTITION BY vec_id // {BLOCK} ORDER BY vec_id) - 1)::INT AS i, list_transform(embedding, lambda e: floor(e::DOUBLE * 256)) AS x FROM embeddings),
lens AS (SELECT rec, count(*)::INT AS length FROM res GROUP BY rec),
hd AS (SELECT rec, i, h, x[h * 16 + 1 : h * 16 + 16] AS x FROM res, (SELECT unnest(range(4))::INT AS h)),
cells AS (SELECT a.rec, CASE WHEN a.h < 2 THEN 13 ELSE 35 END AS layer, a.h % 2 AS head, a.i, b.i AS j, greatest(0.0, list_inner_product(a.x, b.x)) AS v FROM hd a JOIN hd b ON a.rec = b.rec AND a.h = b.h)"""
APC = f"""{CELLS}, rs AS (SELECT rec, layer, head, i, sum(v) AS s FROM cells GROUP BY ALL), ts AS (SELECT rec, layer, head, sum(s) AS t FROM rs GROUP BY ALL),
apc AS (SELECT c.rec, c.layer, c.i, c.j, CASE WHEN abs(c.i - c.j) < 6 THEN 0.0 ELSE avg(greatest(0.0, c.v - r.s * q.s / (t.t + 1e-12::DOUBLE))) END AS v FROM cells c
  JOIN rs r ON r.rec = c.rec AND r.layer = c.layer AND r.head = c.head AND r.i = c.i JOIN rs q ON q.rec = c.rec AND q.layer = c.layer AND q.head = c.head AND q.i = c.j
  JOIN ts t ON t.rec = c.rec AND t.layer = c.layer AND t.head = c.head GROUP BY c.rec, c.layer, c.i, c.j),
mat AS (SELECT rec, layer, i, j, floor(v) AS v FROM apc)"""
TRACKS = f"""{APC}, dg AS (SELECT rec, layer, j - i AS sep, i AS pos, v FROM mat WHERE j > i AND j - i <= {MOST}),
d1 AS (SELECT rec, layer, sep, quantile_cont(v, 0.25) AS base, median(v) AS mid, stddev_pop(v) AS sd FROM dg GROUP BY ALL),
d2 AS (SELECT dg.rec, dg.layer, dg.sep, median(abs((v - base) - (mid - base))) AS mad FROM dg JOIN d1 USING (rec, layer, sep) GROUP BY ALL),
d3 AS (SELECT rec, layer, sep, base, CASE WHEN 1.4826::DOUBLE * mad >= 1e-12::DOUBLE THEN 1.4826::DOUBLE * mad WHEN sd >= 1e-12::DOUBLE THEN sd END AS scale FROM d1 JOIN d2 USING (rec, layer, sep)),
zt AS (SELECT dg.rec, dg.layer, dg.sep, dg.pos, CASE WHEN scale IS NULL THEN 0.0 ELSE least(8.0, greatest(-8.0, (v - base) / scale)) END AS z FROM dg JOIN d3 USING (rec, layer, sep)),
tr AS (SELECT rec, layer, sep, pos, floor(z * 1000)::BIGINT AS z FROM zt)"""
FUSED = f"{TRACKS}, fu AS (SELECT rec, sep, pos, floor(avg(z)) AS z FROM tr GROUP BY ALL)"


@query(f"WITH {APC} SELECT rec, layer, i, j, floor(v * 1000)::BIGINT AS v FROM apc")
def apc_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.apc_head_mean(cells(spark, sf_dir)).withColumn("v", F.floor(F.col("v") * 1000))


@query(f"WITH {APC} SELECT rec, layer, j - i AS sep, round(avg(v), 6) AS mean FROM mat WHERE j > i GROUP BY ALL")
def diag_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.diagonal_profile(matrix(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {TRACKS} SELECT rec, layer, sep, pos, z FROM tr")
def diag_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir)


@query(f"WITH {FUSED} SELECT rec, sep, pos, z FROM fu")
def fuse_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir)


@query(f"""WITH {APC}, s AS (SELECT rec, layer, quantile_cont(v, 0.95) AS s FROM mat WHERE v > 0 GROUP BY ALL)
SELECT rec, layer, i, j, round(CASE WHEN s > 0 THEN least(greatest(ln(1 + v / s), 0), ln(9.0::DOUBLE)) / ln(9.0::DOUBLE) ELSE 0.0 END, 6) AS c FROM mat LEFT JOIN s USING (rec, layer)""")
def attention_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.robust_channel(matrix(spark, sf_dir)).withColumn("c", F.round("c", 6))


@query(f"""WITH {APC}, t AS (SELECT rec, layer, v, i, j, unnest(range(0, 2)) * 64 AS cs FROM mat)
SELECT t.rec, layer, cs::INT AS core_start, (i - cs + 32)::INT AS ti, (j - cs + 32)::INT AS tj, v FROM t JOIN lens USING (rec)
WHERE cs < length AND i - cs + 32 BETWEEN 0 AND 127 AND j - cs + 32 BETWEEN 0 AND 127""")
def extract_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.tile_cells(matrix(spark, sf_dir), lengths(spark, sf_dir))


@query(f"""WITH {CELLS}, f AS (SELECT rec, CASE WHEN d < 32 THEN 13 ELSE 35 END AS layer, (d % 32)::INT AS dim, x[d + 1] AS x FROM res, (SELECT unnest(range(64)) AS d))
SELECT rec, layer, dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM f GROUP BY ALL""")
def pool_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = F.explode(F.array(F.struct(F.lit(13).alias("layer"), F.slice("x", 1, 32).alias("values")), F.struct(F.lit(35).alias("layer"), F.slice("x", 33, 32).alias("values"))))
    out = mx.pooled_features(residues(spark, sf_dir).select("rec", halves.alias("f")).select("rec", "f.layer", "f.values"))
    return out.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


_TEMPLATES = ", ".join(f"({p}::DOUBLE, {w})" for p in PERIODS for w in WIDTHS)
WEDGE = f"""{FUSED}, tp(period, w0) AS (VALUES {_TEMPLATES}), mo AS (SELECT rec, max(sep) AS most FROM fu GROUP BY rec), sz AS (SELECT rec, sep, count(*) AS n FROM fu GROUP BY ALL),
ct AS (SELECT DISTINCT rec, length, period, least(w0, length) AS width, least(most, least(w0, length) - 1) AS lim FROM lens JOIN mo USING (rec), tp),
hk AS (SELECT *, unnest(range(1, 9)) AS k FROM ct), hs AS (SELECT *, unnest([1, -1]) AS sign FROM hk WHERE k * period <= lim + 1),
hc AS (SELECT *, CASE WHEN sign = 1 THEN k * period ELSE (k + 0.5::DOUBLE) * period END AS centre FROM hs),
ho AS (SELECT *, round_even(centre, 0)::INT + unnest([-1, 0, 1]) AS sep FROM hc WHERE centre <= lim + 1),
me AS (SELECT ho.*, sign / sqrt(k::DOUBLE) / count(*) OVER (PARTITION BY ho.rec, period, width, k, sign) AS w, width - ho.sep AS inc FROM ho JOIN sz ON sz.rec = ho.rec AND sz.sep = ho.sep WHERE ho.sep >= 1 AND ho.sep <= lim AND n = length - ho.sep AND ho.sep < width),
kp AS (SELECT rec, period, width FROM me WHERE sign = 1 GROUP BY ALL HAVING count(DISTINCT k) >= 2),
px AS (SELECT rec, sep, pos + 1 AS p, sum(z) OVER (PARTITION BY rec, sep ORDER BY pos) AS s FROM fu UNION ALL SELECT DISTINCT rec, sep, 0, 0 FROM fu),
st AS (SELECT me.*, unnest(range(0, length - me.width + 1)) AS start FROM me JOIN kp ON kp.rec = me.rec AND kp.period = me.period AND kp.width = me.width),
ws AS (SELECT st.rec, st.period, st.width, st.start::INT AS start, sum(st.w * (b.s - a.s)) / sqrt(greatest(sum(st.w * st.w * st.inc), 1e-12::DOUBLE)) AS score FROM st
  JOIN px a ON a.rec = st.rec AND a.sep = st.sep AND a.p = st.start JOIN px b ON b.rec = st.rec AND b.sep = st.sep AND b.p = st.start + st.inc GROUP BY ALL)"""


def _wedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wg.start_scores(fused(spark, sf_dir), lengths(spark, sf_dir), templates(spark))


@query(f"WITH {WEDGE} SELECT rec, period, width, start, round(score, 6) AS score FROM ws")
def wedge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wedge(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"""WITH {WEDGE}, b AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY round(score, 6) DESC, period, width, start) AS k FROM ws)
SELECT rec, period, width, start, start + width AS "end", round(score, 6) AS score FROM b WHERE k = 1""")
def wedge_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wg.best_interval(_wedge(spark, sf_dir).withColumn("score", F.round("score", 6)))


@query(f"""WITH {FUSED}, sz AS (SELECT rec, sep, count(*) AS n FROM fu GROUP BY ALL), ct AS (SELECT DISTINCT rec, length, least(w, length) AS width FROM lens, (SELECT unnest({WIDTHS}) AS w)),
me AS (SELECT ct.*, sz.sep, width - sz.sep AS inc, unnest(range(0, length - width + 1)) AS start FROM ct JOIN sz ON sz.rec = ct.rec WHERE n = length - sz.sep AND sz.sep < width AND sz.sep >= 6),
px AS (SELECT rec, sep, pos + 1 AS p, sum(z) OVER (PARTITION BY rec, sep ORDER BY pos) AS s FROM fu UNION ALL SELECT DISTINCT rec, sep, 0, 0 FROM fu),
ds AS (SELECT me.rec, me.width, me.start::INT AS start, sum(b.s - a.s) / sqrt(sum(inc)) AS score FROM me JOIN px a ON a.rec = me.rec AND a.sep = me.sep AND a.p = me.start JOIN px b ON b.rec = me.rec AND b.sep = me.sep AND b.p = me.start + me.inc GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY round(score, 6) DESC, width, start) AS k FROM ds)
SELECT rec, width, start, start + width AS "end", round(score, 6) AS score FROM k WHERE k = 1""")
def dense_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = spark.createDataFrame([(w,) for w in WIDTHS], "width int")
    return wg.best_interval(wg.dense_scores(fused(spark, sf_dir), lengths(spark, sf_dir), widths).withColumn("score", F.round("score", 6)), period=False)


#: Residue evidence at period 11.5, unrounded, as hr0.
RESIDUES = f"""{FUSED}, mo AS (SELECT rec, max(sep) AS lim FROM fu GROUP BY rec), sz AS (SELECT rec, sep, count(*) AS n FROM fu GROUP BY ALL),
hk AS (SELECT rec, length, lim, unnest(range(1, 9)) AS k FROM lens JOIN mo USING (rec)), hs AS (SELECT *, unnest([1, -1]) AS sign FROM hk WHERE k * 11.5::DOUBLE <= lim + 1),
hc AS (SELECT *, CASE WHEN sign = 1 THEN k * 11.5::DOUBLE ELSE (k + 0.5::DOUBLE) * 11.5::DOUBLE END AS centre FROM hs), ho AS (SELECT *, round_even(centre, 0)::INT + unnest([-1, 0, 1]) AS sep FROM hc WHERE centre <= lim + 1),
me AS (SELECT ho.rec, ho.sep, k, sign, sign / sqrt(k::DOUBLE) / count(*) OVER (PARTITION BY ho.rec, k, sign) AS w FROM ho JOIN sz ON sz.rec = ho.rec AND sz.sep = ho.sep WHERE ho.sep >= 1 AND ho.sep <= lim AND n = length - ho.sep),
kp AS (SELECT rec FROM me WHERE sign = 1 GROUP BY rec HAVING count(DISTINCT k) >= 2),
e AS (SELECT me.rec, unnest([pos, pos + me.sep])::INT AS pos, w, z FROM me JOIN kp USING (rec) JOIN fu ON fu.rec = me.rec AND fu.sep = me.sep),
hr0 AS (SELECT rec, pos, sum(w * z) / sqrt(greatest(sum(w * w), 1e-12::DOUBLE)) AS score FROM e GROUP BY ALL)"""


@query(f"WITH {RESIDUES} SELECT rec, pos, round(score, 5) AS score FROM hr0")
def harmonic_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lengths(spark, sf_dir).withColumn("period", F.lit(11.5))
    return wg.residue_scores(fused(spark, sf_dir), own).withColumn("score", F.round("score", 5))


UNITS = """ed AS (SELECT DISTINCT rec, least(length, greatest(0, unnest(range(-7, length + 12, 12)))) AS e FROM lens), un0 AS (SELECT rec, e AS s, lead(e) OVER (PARTITION BY rec ORDER BY e) AS t FROM ed),
un AS (SELECT rec, (row_number() OVER (PARTITION BY rec ORDER BY s) - 1)::INT AS unit, s, t FROM un0 WHERE t - s >= 0.45::DOUBLE * 12),
bl AS (SELECT m.rec, m.layer, a.unit AS a, b.unit AS b, avg(v) AS mean FROM mat m JOIN un a ON a.rec = m.rec AND m.i >= a.s AND m.i < a.t JOIN un b ON b.rec = m.rec AND m.j >= b.s AND m.j < b.t WHERE a.unit <= b.unit GROUP BY ALL)"""


@query(f"WITH {APC}, {UNITS} SELECT rec, layer, a, b, round(mean, 6) AS mean FROM bl")
def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.block_means(matrix(spark, sf_dir), units(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {APC}, {UNITS}, z AS (SELECT rec, layer, max(b) + 1 AS n_units, median(CASE WHEN b = a + 1 THEN mean END) AS adj FROM bl GROUP BY ALL)
SELECT rec, layer, n_units, round(mean, 6) AS closure, round(adj, 6) AS adjacent, round(-ln((mean + greatest(abs(adj) * 1e-6::DOUBLE, 1e-12::DOUBLE)) / (adj + greatest(abs(adj) * 1e-6::DOUBLE, 1e-12::DOUBLE))), 6) AS open_score
FROM bl JOIN z USING (rec, layer) WHERE a = 0 AND b = n_units - 1 AND n_units >= 3""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mx.closure_scores(mx.block_means(matrix(spark, sf_dir), units(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("closure", "adjacent", "open_score")})


@query(f"""WITH {APC}, {UNITS}, sp AS (SELECT s.rec, s.layer, s.a, s.b, s.mean, median(e.mean) AS adj FROM bl s JOIN bl e ON e.rec = s.rec AND e.layer = s.layer AND e.b = e.a + 1 AND e.a >= s.a AND e.b <= s.b WHERE s.b >= s.a + 2 GROUP BY ALL),
os AS (SELECT *, -ln((mean + greatest(abs(adj) * 1e-6::DOUBLE, 1e-12::DOUBLE)) / (adj + greatest(abs(adj) * 1e-6::DOUBLE, 1e-12::DOUBLE))) AS o, a <= 2 AND b >= 4 AS core FROM sp)
SELECT rec, layer, count(*) FILTER (core) AS candidate_count, round(min(o) FILTER (core), 6) AS open_minimum, round(quantile_cont(o, 0.05) FILTER (core), 6) AS open_q05, round(quantile_cont(o, 0.1) FILTER (core), 6) AS open_q10,
  round(median(o) FILTER (core), 6) AS open_median, count(*) FILTER (NOT core) AS other_count, round(min(o) FILTER (NOT core), 6) AS other_minimum FROM os GROUP BY ALL""")
def boundary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = lengths(spark, sf_dir).select("rec", F.lit(2).alias("first"), F.lit(4).alias("last"))
    out = mx.boundary_scan(mx.boundary_candidates(mx.block_means(matrix(spark, sf_dir), units(spark, sf_dir)), core))
    return out.select("rec", "layer", "candidate_count", *[F.round(c, 6).alias(c) for c in ("open_minimum", "open_q05", "open_q10", "open_median")], "other_count", F.round("other_minimum", 6).alias("other_minimum"))


@query(f"""WITH {TRACKS}, n AS (SELECT *, count(*) OVER (PARTITION BY rec, layer, sep) AS n FROM tr)
SELECT rec, layer, sep, ((pos + ('0x' || substr(md5('null-1:' || rec || ':' || layer || ':' || sep), 1, 12))::BIGINT % n) % n)::INT AS pos, z FROM n""")
def phase_randomize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.phase_randomized(tracks(spark, sf_dir), "null-1")


@query()
def wedge_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wg.distinct_loci(_wedge(spark, sf_dir))
