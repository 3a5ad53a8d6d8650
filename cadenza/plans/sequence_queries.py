"""Queries over sequences, scores and one-dimensional tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import calibration as cal
from cadenza.functions import encoding as enc
from cadenza.functions import sequence as sq
from cadenza.functions import table_functions
from cadenza.operators import intervals as iv
from cadenza.operators import ranking
from cadenza.plans import inputs
from cadenza.plans.inputs import HOURLY_SQL, RAW_SQL, SEQ_SQL, TRACK_SQL
from cadenza.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SYMBOLS = f"array_to_string(list_sort(list_distinct(regexp_extract_all(upper(raw), '[^{sq.CANONICAL}]'))), '')"


@query(f"WITH {RAW_SQL} SELECT record_id, len(raw)::INT AS length, CASE WHEN len(raw) = 0 THEN 'empty' WHEN NOT regexp_full_match(upper(raw), '[{sq.CANONICAL}]+') THEN 'noncanonical' WHEN len(raw) > 2046 THEN 'too_long' ELSE 'ok' END AS status FROM raw")
def canonical_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.raw_sequences(spark, sf_dir).select("record_id", F.length("raw").alias("length"), sq.sequence_status(F.col("raw")).alias("status"))


@query(f"WITH {RAW_SQL} SELECT record_id, {_SYMBOLS} AS symbols FROM raw")
def noncanonical_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.raw_sequences(spark, sf_dir).select("record_id", F.array_join(sq.noncanonical_residues(F.col("raw")), "").alias("symbols"))


@query(f"WITH {RAW_SQL}, s AS (SELECT record_id, regexp_replace(upper(raw), '\\*$', '') AS sequence FROM raw) SELECT record_id, len(sequence)::INT AS length, contains(sequence, '*') AS has_inner_stop FROM s")
def fasta_stop_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inputs.raw_sequences(spark, sf_dir).withColumn("sequence", sq.strip_stop(F.col("raw")))
    return s.select("record_id", F.length("sequence").alias("length"), F.col("sequence").contains("*").alias("has_inner_stop"))


@query(f"WITH {SEQ_SQL} SELECT record_id, length, sha256(sequence) AS sequence_sha256 FROM seqs")
def sequence_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.sequences(spark, sf_dir).select("record_id", "length", sq.sequence_digest(F.col("sequence")).alias("sequence_sha256"))


@query(f"""WITH {RAW_SQL}, v AS (SELECT (record_id // 2 * 2 + CASE WHEN record_id % 10 = 1 THEN 0 ELSE record_id % 2 END) AS id, raw,
  CASE WHEN len(raw) = 0 THEN 'empty' WHEN NOT regexp_full_match(upper(raw), '[{sq.CANONICAL}]+') THEN 'noncanonical' WHEN len(raw) > 2046 THEN 'too_long' ELSE 'ok' END AS status,
  sha256(raw) AS good, CASE WHEN record_id % 11 = 0 THEN 'x' ELSE sha256(raw) END AS claimed FROM raw)
SELECT count(*) AS records, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'noncanonical') AS noncanonical, count(*) FILTER (status = 'too_long') AS too_long,
  count(*) FILTER (good <> claimed) AS digest_mismatch, (SELECT count(*) FROM (SELECT id FROM v GROUP BY id HAVING count(*) > 1)) AS duplicate_ids FROM v""")
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.raw_sequences(spark, sf_dir)
    i = F.col("record_id")
    twin = F.floor(i / 2) * 2 + F.when(i % 10 == 1, 0).otherwise(i % 2)
    claimed = F.when(i % 11 == 0, "x").otherwise(sq.sequence_digest(F.col("raw")))
    return sq.record_issues(raw.select(twin.alias("record_id"), F.col("raw").alias("sequence"), claimed.alias("sequence_sha256")))


_FULL = "w.held >= 16 OR greatest(w.widest, o.length + 2)::BIGINT ** 2 * (w.held + 1) > 40000000"


@query(f"""WITH RECURSIVE {SEQ_SQL}, o AS (SELECT record_id, length, row_number() OVER (ORDER BY length, record_id) AS k FROM seqs),
w AS (SELECT k, record_id, length, 0::BIGINT AS batch, 1 AS held, length + 2 AS widest FROM o WHERE k = 1
  UNION ALL SELECT o.k, o.record_id, o.length, CASE WHEN {_FULL} THEN w.batch + 1 ELSE w.batch END, CASE WHEN {_FULL} THEN 1 ELSE w.held + 1 END,
    CASE WHEN {_FULL} THEN o.length + 2 ELSE greatest(w.widest, o.length + 2) END FROM w JOIN o ON o.k = w.k + 1)
SELECT record_id, length, batch FROM w""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.greedy_batches(inputs.sequences(spark, sf_dir).select("record_id", "length"), budget=40_000_000, most=16)


@query(f"""WITH {SEQ_SQL}, z AS (SELECT DISTINCT record_id, length, least(length, s) AS size FROM seqs, (SELECT unnest([128, 256, 512, 1024]) AS s) WHERE length > 0
  UNION SELECT record_id, length, length FROM seqs WHERE length > 0 AND length < 1024),
p AS (SELECT record_id, length, size, greatest(16, round_even(size * 0.25::DOUBLE, 0)::INT) AS stride FROM z)
SELECT DISTINCT record_id, start::INT AS start, (start + size)::INT AS "end", size::INT AS window_size FROM (
  SELECT record_id, size, unnest(range(0, greatest(1, length - size + 1), stride)) AS start FROM p UNION ALL SELECT record_id, size, length - size FROM p)""")
def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.window_plan(inputs.sequences(spark, sf_dir).select("record_id", "length")).select("record_id", "start", "end", "window_size")


@query(f"WITH {SEQ_SQL} SELECT record_id, s::INT AS core_start, least(s + 64, length)::INT AS core_end, (s - 32)::INT AS tile_start, (s + 96)::INT AS tile_end FROM (SELECT record_id, length, unnest(range(0, length, 64)) AS s FROM seqs)")
def tile_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.tile_spans(inputs.sequences(spark, sf_dir).select("record_id", "length")).drop("length")


@query(f"""WITH {SEQ_SQL}, r AS (SELECT record_id, length, (10 + record_id % 31)::INT AS period, (record_id % 17)::INT AS off FROM seqs WHERE length > 0),
e AS (SELECT record_id, length, period, unnest(range(off - period * ((off + period - 1) // period), length + period, period)) AS raw FROM r),
c AS (SELECT DISTINCT record_id, length, period, least(length, greatest(0, raw)) AS edge FROM e),
t AS (SELECT *, lead(edge) OVER (PARTITION BY record_id ORDER BY edge) AS nxt FROM c)
SELECT record_id, (row_number() OVER (PARTITION BY record_id ORDER BY edge) - 1)::INT AS unit, edge::INT AS start, nxt::INT AS "end" FROM t WHERE nxt - edge >= 0.45::DOUBLE * period""")
def periodic_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("record_id")
    rows = inputs.sequences(spark, sf_dir).filter("length > 0").select("record_id", "length", (10 + i % 31).cast("double").alias("period"), (i % 17).cast("double").alias("offset"))
    return iv.periodic_tiles(rows).select("record_id", "unit", "start", "end")


@query(f"""WITH {SEQ_SQL}, t(residue, factor, value) AS (VALUES {enc.table_sql()}), c AS (SELECT record_id, r AS residue, count(*) AS n FROM (SELECT record_id, unnest(string_split(sequence, '')) AS r FROM seqs WHERE length > 0) GROUP BY 1, 2)
SELECT record_id, factor, sum(n * value)::BIGINT AS factor_sum FROM c JOIN t USING (residue) GROUP BY 1, 2""")
def atchley_encode_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enc.factor_sums(inputs.sequences(spark, sf_dir), "record_id", "sequence")


@query(f"""WITH {RAW_SQL}, m AS (SELECT o_custkey AS owner, o_orderkey AS id, raw FROM orders JOIN raw ON record_id = o_orderkey % (SELECT count(*) FROM documents)),
b AS (SELECT owner, id, {_SYMBOLS} AS symbols FROM m WHERE len(raw) = 0 OR NOT regexp_full_match(upper(raw), '[{sq.CANONICAL}]+'))
SELECT owner, count(*) AS sequences, count(b.id) AS bad, min(b.id) AS first_bad, arg_min(b.symbols, b.id) AS first_symbols FROM m LEFT JOIN b USING (owner, id) GROUP BY owner""")
def canonical_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' maps of order to the letters of a document: how many sequences are at fault, and the first of them."""
    raw = inputs.raw_sequences(spark, sf_dir)
    size = raw.count()
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % size).alias("record_id"))
    # a map holds what matters of a sequence: its symbols at fault, or one letter
    marks = raw.select("record_id", F.when(F.col("raw") == "", F.lit("")).otherwise(F.coalesce(F.nullif(F.array_join(sq.noncanonical_residues(F.col("raw")), ""), F.lit("")), F.lit("A"))).alias("sequence"))
    own = orders.join(marks, "record_id").groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("id", "sequence"))).alias("m"))
    bad = own.select("owner", F.size("m").cast("long").alias("sequences"), F.array_sort(F.map_entries(sq.noncanonical_map(F.col("m")))).alias("b"))
    first = F.get("b", F.lit(0))
    return bad.select("owner", "sequences", F.size("b").cast("long").alias("bad"), first["key"].alias("first_bad"), first["value"].alias("first_symbols"))


@query(f"""WITH {SEQ_SQL} SELECT record_id, r AS residue, count(*) AS n FROM (SELECT record_id, unnest(string_split(sequence, '')) AS r FROM seqs WHERE length > 0) GROUP BY 1, 2""")
def onehot_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enc.composition(inputs.sequences(spark, sf_dir), "record_id", "sequence")


@query(f"""WITH {HOURLY_SQL}, s AS (SELECT *, avg(n) OVER w AS m, regr_slope(n, hour) OVER w AS b, avg(hour) OVER w AS mh FROM hourly WINDOW w AS (PARTITION BY event_type)),
c AS (SELECT event_type, hour, (n - m) - b * (hour - mh) AS x FROM s)
SELECT event_type, hour, round(x / stddev_pop(x) OVER (PARTITION BY event_type), 6) + 0.0 AS standardized FROM c""")
def detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = enc.detrended(inputs.hourly(spark, sf_dir), "event_type", "hour", "n")
    return out.select("event_type", "hour", (F.round("standardized", 6) + 0.0).alias("standardized"))


@query("SELECT c_custkey, c_mktsegment, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC)::INT AS rank FROM customer")
def dense_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dense_ranks(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "rank")


@query("""SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place, concat_ws(chr(9), o_orderkey::VARCHAR, printf('%.2f', o_totalprice), o_orderstatus,
  CASE WHEN o_orderstatus = 'F' THEN o_custkey::VARCHAR ELSE '' END, o_orderpriority) AS line FROM orders""")
def ranked_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated lines of all orders, the dearest first; open orders leave a field empty."""
    columns = [F.col("o_orderkey"), F.format_string("%.2f", "o_totalprice"), F.col("o_orderstatus"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")), F.col("o_orderpriority")]
    return ranking.report_lines(table(spark, sf_dir, "orders"), "o_totalprice", columns, ["o_orderkey"])


_P = "(c_acctbal + 1000) / 11500"
_LOGIT = "ln(least(greatest({p}, 1e-5::DOUBLE), 1 - 1e-5::DOUBLE) / (1 - least(greatest({p}, 1e-5::DOUBLE), 1 - 1e-5::DOUBLE)))"
_TZ = f"(({_LOGIT}) - ({cal.TEACHER_LOGIT[0]!r}::DOUBLE)) / {cal.TEACHER_LOGIT[1]!r}::DOUBLE"
_GZ = f"(({_LOGIT}) - ({cal.GLOBAL_LOGIT[0]!r}::DOUBLE)) / {cal.GLOBAL_LOGIT[1]!r}::DOUBLE"


@query(f"SELECT c_custkey, round({_TZ.format(p=_P)}, 8) AS z FROM customer")
def logit_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("c_acctbal") + 1000) / 11500
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(cal.standardized(cal.clipped_logit(p), *cal.TEACHER_LOGIT), 8).alias("z"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("record")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("o_totalprice"))).alias("s"))
    rows = orders.select("record", (F.col("n") * 16).alias("length"), F.explode(F.array(F.struct(F.lit(13).alias("layer"), (F.col("s") % 1000 / 100.0).alias("score")), F.struct(F.lit(35).alias("layer"), (F.col("s") % 777 / 50.0).alias("score")))).alias("f"))
    return rows.select("record", "length", "f.layer", "f.score")


LAYERS_SQL = """o AS (SELECT o_custkey AS record, count(*) AS n, sum(floor(o_totalprice)::BIGINT)::BIGINT AS s FROM orders GROUP BY 1),
feats AS (SELECT record, n * 16 AS length, 13 AS layer, (s % 1000) / 100.0::DOUBLE AS score FROM o UNION ALL SELECT record, n * 16, 35, (s % 777) / 50.0::DOUBLE FROM o)"""


def spectrum_sql() -> str:
    rows = ", ".join(f"({k}, {v['slope']!r}::DOUBLE, {v['intercept']!r}::DOUBLE, {v['mean']!r}::DOUBLE, {v['sd']!r}::DOUBLE)" for k, v in cal.SPECTRUM.items())
    return f"k(layer, slope, icpt, mu, sd) AS (VALUES {rows}), spec AS (SELECT record, count(*) AS layers_seen, avg((ln(1 + score) - (slope * log2(length) + icpt) - mu) / sd) AS spectrum_score FROM feats JOIN k USING (layer) GROUP BY record)"


@query(f"WITH {LAYERS_SQL}, {spectrum_sql()} SELECT record, layers_seen, round(spectrum_score, 8) AS spectrum_score FROM spec")
def frozen_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.spectrum_score(layers(spark, sf_dir), "record").withColumn("spectrum_score", F.round("spectrum_score", 8))


_T, _C = cal.TOPOLOGY, cal.SPECTRUM_CONTROL
_OP_SQL = f"""q AS (SELECT record, spectrum_score, CASE WHEN record % 5 = 0 THEN 'no_wedge_call' ELSE 'ok' END AS status, (record % 40 + 1) AS cand, (record % 97) / 16.0::DOUBLE - 2 AS omin FROM spec),
ops AS (SELECT *, CASE WHEN status = 'ok' THEN {_T['intercept']!r}::DOUBLE + ({_T['coefficient']!r}::DOUBLE) * ln(1 + cand) END AS expected FROM q),
opc AS (SELECT *, CASE WHEN status = 'ok' THEN (omin - expected) / {_T['residual_sd']!r}::DOUBLE ELSE {_T['no_call']!r}::DOUBLE END AS corrected FROM ops),
opz AS (SELECT *, (corrected - ({_T['mean']!r}::DOUBLE)) / {_T['sd']!r}::DOUBLE AS tz, (spectrum_score - {_C['mean']!r}::DOUBLE) / {_C['sd']!r}::DOUBLE AS sz FROM opc)"""
_OP_OUT = "record, CASE WHEN status = 'ok' THEN cand ELSE 0 END AS candidate_count, round(corrected, 8) AS corrected_topology_score, round(tz, 8) AS topology_z, round(sz, 8) AS spectrum_z, round(0.5 * tz + 0.5 * sz, 8) AS fusion_score"


def _operational(rows: DataFrame) -> DataFrame:
    i = F.col("record")
    rows = rows.select("record", "spectrum_score", F.when(i % 5 == 0, "no_wedge_call").otherwise("ok").alias("status"), (i % 40 + 1).alias("cand"), ((i % 97) / 16.0 - 2).alias("omin"))
    cols = cal.operational_scores(F.col("status"), F.col("cand"), F.col("omin"), F.col("spectrum_score"))
    return rows.select("record", F.col("cand"), F.col("omin"), "status", *[v.alias(k) for k, v in cols.items()])


def _rounded(df: DataFrame, *names: str) -> list:
    return [F.round(n, 8).alias(n) for n in names]


@query(f"WITH {LAYERS_SQL}, {spectrum_sql()}, {_OP_SQL} SELECT {_OP_OUT} FROM opz")
def operational_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _operational(cal.spectrum_score(layers(spark, sf_dir), "record"))
    return out.select("record", "candidate_count", *_rounded(out, "corrected_topology_score", "topology_z", "spectrum_z", "fusion_score"))


@query(f"WITH {LAYERS_SQL}, {spectrum_sql()}, {_OP_SQL} SELECT {_OP_OUT} FROM opz")
def rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as nested JSON strings, read back, and calibrated anew from their raw values."""
    nested = layers(spark, sf_dir).groupBy("record").agg(F.first("length").alias("length"), F.map_from_entries(F.collect_list(F.struct(F.col("layer").cast("string"), F.struct(F.col("score").alias("raw_score"))))).alias("layers"))
    stored = nested.select("record", F.to_json(F.struct("length", F.struct("layers").alias("frozen_spectrum"))).alias("prediction"))
    read = stored.select("record", F.from_json("prediction", "length long, frozen_spectrum struct<layers: map<string, struct<raw_score: double>>>").alias("p"))
    again = read.select("record", F.col("p.length").alias("length"), F.explode("p.frozen_spectrum.layers").alias("layer", "v")).select("record", "length", F.col("layer").cast("int").alias("layer"), F.col("v.raw_score").alias("score"))
    out = _operational(cal.spectrum_score(again, "record"))
    return out.select("record", "candidate_count", *_rounded(out, "corrected_topology_score", "topology_z", "spectrum_z", "fusion_score"))


@query(f"""WITH p AS (SELECT c_custkey AS record, {_P} AS sp, (c_custkey % 200) / 50.0::DOUBLE - 2 AS tz, (c_custkey % 1000) / 1000.0::DOUBLE AS gp FROM customer),
z AS (SELECT record, tz, {_TZ.format(p='sp')} AS t, {_GZ.format(p='gp')} AS g FROM p)
SELECT record, round(t, 8) AS teacher_z, round(g, 8) AS global_z, round(0.5 * t + 0.5 * tz, 8) AS base_score, round(0.75 * (0.5 * t + 0.5 * tz) + 0.25 * g, 8) AS primary_score, round(0.5 * t + 0.5 * g, 8) AS discovery_score FROM z""")
def compose_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    cols = cal.compose_score((F.col("c_acctbal") + 1000) / 11500, (i % 200) / 50.0 - 2, (i % 1000) / 1000.0, cal.TEACHER_LOGIT, cal.GLOBAL_LOGIT)
    return table(spark, sf_dir, "customer").select(i.alias("record"), *[F.round(v, 8).alias(k) for k, v in cols.items()])


#: A made-up router to exercise the function; no fitted model is part of this repository.
ROUTER = {"mean": [0.5, 0.6, 0.0, 0.1], "scale": [0.25, 0.3, 1.5, 0.75], "coefficients": [[1.0, 0.5, -0.25, 0.1], [-1.0, 0.25, 0.75, 0.2], [0.2, -0.5, 0.3, -0.4]], "intercepts": [-0.2, 0.1, 0.0]}
_CATEGORIES = ["elongated", "closed", "beads"]


def _router_sql() -> str:
    xs = [f"(({f}) - {m!r}::DOUBLE) / {s!r}::DOUBLE" for f, m, s in zip(("m", "q", "z", "m * z"), ROUTER["mean"], ROUTER["scale"], strict=True)]
    raw = ", ".join(f"1 / (1 + exp(-({b!r}::DOUBLE + " + " + ".join(f"({c!r}::DOUBLE) * ({x})" for c, x in zip(row, xs, strict=True)) + f"))) AS r{k}" for k, (row, b) in enumerate(zip(ROUTER["coefficients"], ROUTER["intercepts"], strict=True)))
    return f"""WITH f AS (SELECT c_custkey AS record, (c_acctbal + 1000) / 11500 AS m, coalesce(n, 0) / (coalesce(n, 0) + 10)::DOUBLE AS q, coalesce(p, 0.0) / 50000::DOUBLE - 3 AS z
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey), s AS (SELECT record, {raw} FROM f),
n AS (SELECT record, r0 / (r0 + r1 + r2) AS p0, r1 / (r0 + r1 + r2) AS p1, r2 / (r0 + r1 + r2) AS p2 FROM s)
SELECT record, round(p0, 8) AS p_elongated, round(p1, 8) AS p_closed, round(p2, 8) AS p_beads,
  CASE WHEN greatest(p0, p1, p2) < 0.4 THEN 'unresolved' WHEN p0 >= p1 AND p0 >= p2 THEN 'elongated' WHEN p1 >= p2 THEN 'closed' ELSE 'beads' END AS category FROM n"""


@query(_router_sql())
def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance, share of orders and mean price of each customer, routed."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("p"))
    own = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    n, price = F.coalesce("n", F.lit(0)), F.coalesce("p", F.lit(0.0))
    features = own.select(F.col("c_custkey").alias("record"), ((F.col("c_acctbal") + 1000) / 11500).alias("m"), (n / (n + 10)).alias("q"), (price / 50000 - 3).alias("z"))
    probabilities = cal.router_probabilities(cal.router_features(F.col("m"), F.col("q"), F.col("z")), ROUTER)
    rows = features.select("record", *[p.alias(f"p_{c}") for p, c in zip(probabilities, _CATEGORIES, strict=True)])
    category = cal.routed_category([F.col(f"p_{c}") for c in _CATEGORIES], _CATEGORIES, 0.4)
    return rows.select("record", *[F.round(f"p_{c}", 8).alias(f"p_{c}") for c in _CATEGORIES], category.alias("category"))


@query("""WITH c AS (SELECT o_custkey AS record, list_sort(list(DISTINCT CASE WHEN o_totalprice >= 100000 AND o_orderstatus = 'F' THEN substr(o_orderpriority, 1, 1) END) FILTER (o_totalprice >= 100000 AND o_orderstatus = 'F')) AS classes FROM orders GROUP BY 1)
SELECT c_custkey AS record, CASE WHEN classes IS NULL OR len(classes) = 0 THEN 'non_repeat' WHEN len(classes) > 1 THEN 'mixed_repeat_architecture'
  ELSE CASE classes[1] WHEN '2' THEN 'fibrous_repeat' WHEN '3' THEN 'elongated_repeat' WHEN '4' THEN 'closed_repeat' WHEN '5' THEN 'beads_on_a_string' ELSE 'other_repeat_architecture' END END AS label
FROM customer LEFT JOIN c ON c.record = c_custkey""")
def architecture_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's classes are the priorities of dear, finished orders; other orders carry none."""
    code = F.when((F.col("o_totalprice") >= 100_000) & (F.col("o_orderstatus") == "F"), F.substring("o_orderpriority", 1, 1))
    codes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(code).alias("classes"))
    rows = table(spark, sf_dir, "customer").join(codes, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("record"), cal.architecture_label(F.coalesce("classes", F.array().cast("array<string>"))).alias("label"))


_RUNS_SQL = f"""{TRACK_SQL}, h AS (SELECT record, pos - row_number() OVER (PARTITION BY record ORDER BY pos) AS isl, pos FROM track WHERE value >= 0.5),
r AS (SELECT record, min(pos) AS s, max(pos) + 1 AS e FROM h GROUP BY record, isl),
runs AS (SELECT record, s AS run_start, e AS run_end, e - s AS run_length FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY e - s DESC, s) AS k FROM r) WHERE k = 1)"""


@query(f"WITH {_RUNS_SQL} SELECT record, run_start::BIGINT AS run_start, run_end::BIGINT AS run_end, run_length::BIGINT AS run_length FROM runs")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = iv.longest_run(inputs.state_track(spark, sf_dir), "record", "pos", "value")
    return out.select("record", *[F.col(c).cast("long").alias(c) for c in ("run_start", "run_end", "run_length")])


@query(f"""WITH {_RUNS_SQL} SELECT t.record, count(*) AS length, round(avg(value), 8) AS mean, round(median(value), 8) AS median, round(quantile_cont(value, 0.9), 8) AS q90,
  round(avg((value >= 0.5)::INT), 8) AS supported_fraction, coalesce(any_value(run_length), 0)::BIGINT AS run_length, round(coalesce(any_value(run_length), 0) / count(*), 8) AS run_fraction
FROM track t LEFT JOIN runs r ON r.record = t.record GROUP BY t.record""")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = iv.track_summary(inputs.state_track(spark, sf_dir), "record", "pos", "value")
    return out.select("record", "length", *_rounded(out, "mean", "median", "q90", "supported_fraction"), F.col("run_length").cast("long").alias("run_length"), F.round("run_fraction", 8).alias("run_fraction"))


@query("""WITH r AS (SELECT l_orderkey, unnest(range(1, 41)) AS p, list({'a': l_linenumber * 4, 'b': l_linenumber * 4 + l_quantity::INT % 5}) AS runs FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, sum(CASE WHEN len(list_filter(runs, lambda x: p >= x.a AND p <= x.b)) > 0 THEN 1 ELSE 0 END)::BIGINT AS covered FROM r GROUP BY l_orderkey""")
def labels_from_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("l_linenumber") * 4
    runs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array(first, first + F.col("l_quantity").cast("int") % 5)).alias("runs"))
    marked = iv.labels_from_runs(F.lit(40), F.col("runs"))
    return runs.select("l_orderkey", F.aggregate(marked, F.lit(0).cast("long"), lambda a, x: a + x).alias("covered"))


@query(f"""WITH {HOURLY_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY event_type)::INT AS len, 5 + len(event_type)::INT AS width FROM hourly),
x AS (SELECT event_type, hour, least(width, len) AS w, len, unnest(range(0, least(width, len)::INT)) AS d FROM w)
SELECT x.event_type, x.hour, round(sum(h.n) / any_value(x.w)::DOUBLE, 8) AS smooth FROM x JOIN hourly h ON h.event_type = x.event_type AND h.hour = greatest(0, least(x.len - 1, x.hour - x.w // 2 + x.d)) GROUP BY 1, 2""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.hourly(spark, sf_dir).withColumn("width", 5 + F.length("event_type"))
    return iv.moving_average(rows, "event_type", "hour", "n", "width").select("event_type", "hour", F.round("smooth", 8).alias("smooth"))


@query(f"""WITH RECURSIVE {TRACK_SQL}, v AS (SELECT record, pos, floor((value - 0.4) * 1000)::BIGINT AS x FROM track),
s AS (SELECT record, pos, x AS total, greatest(x, 0) AS best, CASE WHEN x > 0 THEN 1 ELSE 0 END AS steps, CASE WHEN x > 0 THEN 0 ELSE 1 END AS losses, 1 AS seen FROM v WHERE pos = 0
  UNION ALL SELECT s.record, v.pos, s.total + v.x, greatest(s.best, s.total + v.x), CASE WHEN s.total + v.x > s.best THEN s.seen + 1 ELSE s.steps END, CASE WHEN v.x > 0 THEN 0 ELSE s.losses + 1 END, s.seen + 1
  FROM s JOIN v ON v.record = s.record AND v.pos = s.pos + 1 WHERE s.losses < 3)
SELECT record, arg_max(steps, seen)::INT AS steps, max(seen)::INT AS inspected FROM s GROUP BY record""")
def local_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.state_track(spark, sf_dir).withColumn("x", F.floor((F.col("value") - 0.4) * 1000).cast("double"))
    own = rows.groupBy("record").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda t: t["x"]).alias("xs"))
    return own.withColumn("r", iv.stopping_extension(F.col("xs"), F.lit(3))).select("record", "r.steps", "r.inspected")


@query("""WITH c AS (SELECT l_orderkey AS record, l_linenumber * 20 AS s, l_linenumber * 20 + l_quantity::INT AS e, (l_suppkey % 30)::DOUBLE / 2 AS period, 200::BIGINT AS len, l_linenumber FROM lineitem),
t AS (SELECT *, least(len, greatest(1, round_even(greatest(0, least(len, e - s)) + 2.0 * 0.5 * greatest(period, 0), 0)::BIGINT)) AS w FROM c),
b AS (SELECT *, greatest(0, least(round_even((s + e) / 2.0::DOUBLE - w / 2.0::DOUBLE, 0)::BIGINT, len - w)) AS b FROM t)
SELECT record, l_linenumber, b::BIGINT AS start, (b + w)::BIGINT AS "end" FROM b""")
def expand_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 20
    begin, end = iv.expand_interval(start, start + F.col("l_quantity").cast("int"), (F.col("l_suppkey") % 30) / 2.0, F.lit(200))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), "l_linenumber", begin.cast("long").alias("start"), end.cast("long").alias("end"))


@query("""WITH c AS (SELECT l_orderkey AS record, l_linenumber AS n, l_linenumber * 20 AS s, max(l_linenumber * 20 + l_quantity::INT) AS e FROM lineitem GROUP BY ALL)
SELECT a.record, a.n, round(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))::DOUBLE / ((a.e - a.s) + (b.e - b.s) - greatest(0, least(a.e, b.e) - greatest(a.s, b.s))), 8) AS iou
FROM c a JOIN c b ON b.record = a.record AND b.n = a.n + 1""")
def interval_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 20
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("n"), start.alias("s")).agg(F.max(start + F.col("l_quantity").cast("int")).alias("e"))
    nxt = Window.partitionBy("record").orderBy("n")
    pairs = rows.withColumns({"n2": F.lead("n").over(nxt), "s2": F.lead("s").over(nxt), "e2": F.lead("e").over(nxt)}).filter("n2 = n + 1")
    return pairs.select("record", "n", F.round(iv.interval_iou(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")), 8).alias("iou"))


@query("""WITH w AS (SELECT l_suppkey AS record, 64 + (l_orderkey % 5)::INT * 32 AS window_size, (l_orderkey * 8 + l_linenumber) AS s, l_quantity AS score, l_linenumber AS n_harmonics, (l_partkey % 900) / 10.0::DOUBLE AS period FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY score DESC, n_harmonics DESC, window_size, s) AS k FROM w WHERE window_size >= 96 AND period > 0)
SELECT DISTINCT record, p AS period FROM (SELECT record, round_even(period * m / 0.5::DOUBLE, 0) * 0.5::DOUBLE AS p FROM r, (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS m) WHERE k <= 8) WHERE p BETWEEN 5 AND 80""")
def candidate_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("record"), (64 + (F.col("l_orderkey") % 5).cast("int") * 32).alias("window_size"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("start"), F.lit(0).alias("end"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("n_harmonics"), ((F.col("l_partkey") % 900) / 10.0).alias("period"))
    return iv.candidate_periods(rows, "record")


@query("""WITH n AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice AS x, avg(o_totalprice) OVER (PARTITION BY l_suppkey) / 4 AS obs FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_suppkey, round((1 + count(*) FILTER (x >= floor(obs))) / (count(*) + 1), 8) AS p_value FROM n GROUP BY l_suppkey""")
def pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = lines.select("l_suppkey", "l_extendedprice", F.floor(F.avg("o_totalprice").over(Window.partitionBy("l_suppkey")) / 4).alias("obs"))
    return iv.upper_tail_pvalue(rows, "l_suppkey", "obs", "l_extendedprice").withColumn("p_value", F.round("p_value", 8))


@query(f"""WITH o AS (SELECT o_orderkey AS record_id, regexp_replace(translate(o_orderpriority || o_clerk_free, '{inputs._LOW}', '{inputs._UP}'), '[^{sq.CANONICAL}]', '', 'g') AS sequence FROM (SELECT *, o_orderstatus || o_orderpriority || o_orderkey AS o_clerk_free FROM orders)),
t(residue, factor, value) AS (VALUES {enc.table_sql()}), r AS (SELECT record_id, unnest(string_split(sequence, '')) AS residue, generate_subscripts(string_split(sequence, ''), 1) AS pos FROM o WHERE len(sequence) > 0)
SELECT record_id, factor, sum(value * (pos % 7))::BIGINT AS weighted, max(pos)::INT AS rows FROM r JOIN t USING (residue) GROUP BY record_id, factor""")
def encode_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor rows of the letters in each order's status and priority, weighted by their place."""
    text = F.concat("o_orderpriority", "o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string"))
    letters = F.regexp_replace(F.translate(text, inputs._LOW, inputs._UP), f"[^{sq.CANONICAL}]", "")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), letters.alias("sequence")).filter("sequence <> ''")
    cells = rows.select("record_id", F.posexplode(enc.encode_factors(F.col("sequence"))).alias("pos", "row")).select("record_id", "pos", F.posexplode("row").alias("factor", "value"))
    weighted = F.sum(F.rint(F.col("value") * 1000).cast("long") * ((F.col("pos") + 1) % 7))
    return cells.groupBy("record_id", (F.col("factor") + 1).alias("factor")).agg(weighted.alias("weighted"), (F.max("pos") + 1).alias("rows"))


@query(f"""WITH o AS (SELECT o_orderkey AS record_id, regexp_replace(translate(o_orderpriority || o_orderstatus, '{inputs._LOW}', '{inputs._UP}'), '[^{sq.CANONICAL}]', '', 'g') AS sequence FROM orders),
r AS (SELECT record_id, unnest(string_split(sequence, '')) AS residue, generate_subscripts(string_split(sequence, ''), 1) AS pos FROM o WHERE len(sequence) > 0)
SELECT record_id, (instr('{sq.CANONICAL}', residue) - 1)::INT AS channel, list(pos::INT ORDER BY pos)::VARCHAR AS places FROM r GROUP BY record_id, residue""")
def encode_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each indicator channel of an order's letters is set."""
    letters = F.regexp_replace(F.translate(F.concat("o_orderpriority", "o_orderstatus"), inputs._LOW, inputs._UP), f"[^{sq.CANONICAL}]", "")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), letters.alias("sequence")).filter("sequence <> ''")
    cells = rows.select("record_id", F.posexplode(enc.encode_onehot(F.col("sequence"))).alias("pos", "row")).select("record_id", "pos", F.posexplode("row").alias("channel", "v")).filter("v = 1")
    places = F.array_join(F.array_sort(F.collect_list(F.col("pos") + 1)), ", ")
    return cells.groupBy("record_id", "channel").agg(F.concat(F.lit("["), places, F.lit("]")).alias("places"))


def _from_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query in SQL over the records' lengths, with the table functions."""
    table_functions.register(spark)
    return spark.sql(text, records=inputs.sequences(spark, sf_dir).select("record_id", "length"))


@query(SQL["window_plan"])
def sql_window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, "SELECT record_id, w.start, w.`end`, w.window_size FROM {records}, LATERAL window_plan(length, array(128, 256, 512, 1024)) AS w")


@query(SQL["tile_spans"])
def sql_tile_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, "SELECT record_id, t.* FROM {records}, LATERAL tile_spans(length, 128, 64) AS t")


@query(SQL["periodic_tiles"])
def sql_periodic_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, "SELECT record_id, t.* FROM {records}, LATERAL periodic_tiles(length, CAST(10 + record_id % 31 AS DOUBLE), CAST(record_id % 17 AS DOUBLE)) AS t")
