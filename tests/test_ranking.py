"""Dense ranks, reports, maps of sequences, maps of layer scores, and SQL table functions."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import calibration as cal
from cadenza.functions import encoding as enc
from cadenza.functions import sequence as sq
from cadenza.functions import table_functions
from cadenza.operators import intervals as iv
from cadenza.operators import ranking
from cadenza.plans import sequence_queries


def test_dense_ranks(spark):
    rows = [(k, ["a", "b", None][k % 3], float(k * 7 % 5) if k % 11 else -0.0) for k in range(200)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "k int, g string, v double, place int, rank int").repartition(5)
    out = ranking.dense_ranks(df.drop("rank"), "v", ["g"]).collect()
    for k, g, v in rows:
        (r,) = [r for r in out if r.k == k]
        own = sorted({x for _, h, x in rows if h == g}, reverse=True)
        assert (r.v, r["rank"]) == (v, own.index(v) + 1)
    whole = ranking.dense_ranks(df.drop("rank"), "v").collect()
    every = sorted({v for *_, v in rows}, reverse=True)
    assert all(r["rank"] == every.index(r.v) + 1 for r in whole) and len(whole) == 200
    assert ranking.dense_ranks(df.limit(0), "v", ["g"], "n").count() == 0
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="values to rank must be finite"):
            ranking.dense_ranks(spark.createDataFrame([(1.0,), (bad,)], "v double"), "v").collect()


def test_ranks_of_published_example(spark):
    df = spark.createDataFrame(list(enumerate([0.5, 2.0, 2.0, -1.0])), "k int, v double")
    assert [r["rank"] for r in sorted(ranking.dense_ranks(df, "v").collect(), key=lambda r: r.k)] == [2, 1, 1, 3]


def test_no_task_ranks_a_whole_group(spark):
    """Five groups, one with most of the rows and one value that a third of them share: the shuffled rows stay spread."""
    df = spark.range(40_000).select((F.col("id") % 50).alias("g0"), "id").select(F.when(F.col("g0") < 40, 0).otherwise(F.col("g0") % 5).alias("g"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") * 1.0).alias("v"))
    values = df.select("g", "v").distinct()
    spread = values.repartitionByRange(8, "g", F.desc("v")).groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = sorted(r["count"] for r in spread)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    top = ranking.dense_ranks(df, "v", ["g"]).groupBy("g").agg(F.max("rank").alias("m"), F.count_distinct("v").alias("n")).collect()
    assert all(r.m == r.n for r in top)


def test_report_lines_and_files(spark, tmp_path):
    rows = [("a", 1.5, None), ("b", 9.0, "x\ty"), ("c", 1.5, "z\n"), ("d", -3.0, "")]
    df = spark.createDataFrame(rows, "k string, s double, t string").repartition(4)
    lines = ["b\t9.0\tx y", "a\t1.5\t", "c\t1.5\tz ", "d\t-3.0\t"]
    out = ranking.report_lines(df, "s", [F.col("k"), F.col("s"), F.col("t")], ["k"]).collect()
    assert [r.line for r in sorted(out, key=lambda r: r.place)] == lines and sorted(r.place for r in out) == [0, 1, 2, 3]
    path = str(tmp_path / "report")
    ranking.write_report(df, "s", [F.col("k"), F.col("s"), F.col("t")], ["k"], path)
    assert [x for f in sorted((tmp_path / "report").glob("part-*")) for x in f.read_text().splitlines()] == lines
    with pytest.raises(Exception, match="already exists"):
        ranking.write_report(df, "s", [F.col("k")], ["k"], path)


def test_maps_of_sequences(spark):
    df = spark.createDataFrame([({"a": "acd", "b": "MKV"},), ({},), (None,)], "m map<string, string>")
    out = [r.m for r in df.select(sq.require_canonical_map(F.col("m")).alias("m")).collect()]
    assert out == [{"a": "ACD", "b": "MKV"}, {}, None]
    bad = spark.createDataFrame([({"ok": "ACD", "two": "AXBZ*", "one": "", "zero": None},)], "m map<string, string>")
    assert bad.select(sq.noncanonical_map(F.col("m")).alias("m")).first().m == {"two": "*BXZ", "one": "", "zero": ""}
    with pytest.raises(Exception, match="invalid sequence of two: BX"):
        spark.createDataFrame([({"ok": "ACD", "two": "AXB"},)], "m map<string, string>").select(sq.require_canonical_map(F.col("m"))).collect()


def test_layer_scores_and_nested_spectrum(spark):
    """A hand-computed calibration of two layers."""
    layers = {13: {"slope": 0.5, "intercept": -1.0, "mean": 0.25, "sd": 2.0}, 35: {"slope": 0.0, "intercept": 1.0, "mean": 0.0, "sd": 0.5}}
    df = spark.createDataFrame([(8, [(13, math.e - 1), (35, 0.0), (7, 4.0)])], "n int, f array<struct<layer: int, score: double>>")
    s = df.select(cal.frozen_spectrum(cal.layer_score_map(F.col("f")), F.col("n"), layers).alias("s")).first().s
    assert s.selected_layers == [13, 35] and list(s.layers) == ["13", "35"]
    a, b = s.layers["13"], s.layers["35"]
    assert (a.raw_score, a.log_score, a.expected_control_log_score) == pytest.approx((math.e - 1, 1.0, 0.5))
    assert (a.length_residual, a.length_residual_z) == pytest.approx((0.5, 0.125)) and b.length_residual_z == pytest.approx(-2.0)
    assert s.score == pytest.approx((0.125 - 2.0) / 2)
    kind = "f array<struct<layer: int, score: double>>, n int"
    for features, n, words in (
        ([(13, 1.0), (13, 2.0), (35, 1.0)], 8, "DUPLICATED_MAP_KEY"), ([(13, -1.0), (35, 1.0)], 8, "invalid layer score"), ([(13, float("nan")), (35, 1.0)], 8, "invalid layer score"),
        ([(13, None), (35, 1.0)], 8, "invalid layer score"), ([(13, 1.0)], 8, r"missing selected layers: \\[35\\]".replace("\\\\", "\\")), ([(13, 1.0), (35, 1.0)], 0, "length must be positive"),
    ):
        with pytest.raises(Exception, match=words):
            spark.createDataFrame([(features, n)], kind).select(cal.frozen_spectrum(cal.layer_score_map(F.col("f")), F.col("n"), layers)).collect()


def test_table_functions_equal_the_operators(spark):
    table_functions.register(spark)
    rows = spark.createDataFrame([(k, n, 3.0 + k % 7 * 1.5, (k % 5) * 0.75) for k, n in enumerate([1, 2, 15, 16, 63, 64, 65, 127, 128, 129, 300, 511, 1025, 2046])], "k int, length int, period double, offset double")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    windows = spark.sql("SELECT k, w.* FROM {r}, LATERAL window_plan(length, array(256, 128)) AS w", r=rows)
    assert same(windows, iv.window_plan(rows, (128, 256)).select("k", "start", "end", "window_size"))
    spans = spark.sql("SELECT k, t.* FROM {r}, LATERAL tile_spans(length, 32, 16) AS t", r=rows)
    assert same(spans, iv.tile_spans(rows, 32, 16).select("k", "core_start", "core_end", "tile_start", "tile_end"))
    tiles = spark.sql("SELECT k, t.* FROM {r}, LATERAL periodic_tiles(length, period, offset) AS t", r=rows)
    assert same(tiles, iv.periodic_tiles(rows).select("k", "unit", "start", "end"))
    for df in (windows, spans, tiles):
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", df._jdf.queryExecution().toString())
    none = spark.createDataFrame([(0,), (None,), (-3,)], "length int")
    assert spark.sql("SELECT * FROM {r}, LATERAL window_plan(length, array(64)) AS w, LATERAL tile_spans(length, 4, 2) AS t", r=none).count() == 0


def test_encodings(spark):
    draw = np.random.default_rng(2)
    texts = ["ACDEFGHIKLMNPQRSTVWY", "w", "acd", "".join(draw.choice(list(enc.ATCHLEY), 300))]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "s string")
    norms = np.sqrt((np.array(list(enc.ATCHLEY.values())) ** 2).sum(0))
    for text, a, b, c in df.select("s", enc.encode_factors(F.col("s")), enc.encode_normalized_factors(F.col("s")), enc.encode_onehot(F.col("s"))).collect():
        if text is None:
            assert a is b is c is None
            continue
        want = np.array([enc.ATCHLEY[r] for r in text.upper()])
        assert (np.array(a) == want).all() and np.allclose(b, want / norms) and (np.array(c) == np.eye(20)[["ACDEFGHIKLMNPQRSTVWY".index(r) for r in text.upper()]]).all()
    for bad in ("AXB", ""):
        with pytest.raises(Exception, match="invalid sequence: " + "".join(sorted(set(bad) - {"A"}))):
            spark.createDataFrame([(bad,)], "s string").select(enc.encode_factors(F.col("s"))).collect()


def test_router_models_are_checked(spark):
    good = {"mean": [0.0, 1.0], "scale": [1.0, 2.0], "coefficients": [[1.0, -1.0], [0.5, 0.25], [0.0, 1.0]], "intercepts": [0.1, 0.2, -0.3]}
    df = spark.createDataFrame([(0.5, -2.0)], "a double, b double")
    got = list(df.select(*cal.router_probabilities([F.col("a"), F.col("b")], good)).first())
    x = np.array([0.5, -1.5])
    raw = 1 / (1 + np.exp(-(np.array(good["coefficients"]) @ x + good["intercepts"])))
    assert got == pytest.approx(list(raw / raw.sum()))
    for change, words in (({"mean": [0.0]}, "scaler"), ({"coefficients": [[1.0]]}, "coefficient"), ({"intercepts": [0.0]}, "intercept"), ({"scale": [1.0, 0.0]}, "positive"), ({"mean": [0.0, float("nan")]}, "nonfinite"), ({"categories": ["x", "x", "y"]}, "categories"), ({"features": ["a", "b"]}, "features")):
        with pytest.raises(ValueError, match=words):
            cal.validated_router({**good, **change}, 2)
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="router feature"):
            spark.createDataFrame([(0.5, bad)], "a double, b double").select(*cal.router_probabilities([F.col("a"), F.col("b")], good)).collect()


def test_rescored_predictions_equal_the_sql(spark, sf_dir):
    """Scores calibrated anew from stored predictions are those of the tables' own values."""
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf_dir}/orders.parquet'")
    want = sorted(duck.execute(sequence_queries.SQL["rescore"]).fetchall())
    got = sorted(map(tuple, sequence_queries.rescore(spark, sf_dir).collect()))
    assert want and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-8)
