import inspect

from pyspark.sql import functions as F

from cadenza.operators import matrices as mx
from cadenza.operators import wedge as wg
from cadenza.plans import matrix_queries as mq
from cadenza.plans import signal_queries, topology


def test_decoding_keeps_every_diagonal(spark, monkeypatch):
    """Of a 96-long record the registered decoding reads all 95 diagonals, so that a period of 30 has a template row."""
    decode, taken = inspect.signature(topology.decode), {}

    def take(*args, **named):
        bound = decode.bind(*args, **named)
        bound.apply_defaults()
        taken.update(bound.arguments)

    monkeypatch.setattr(topology, "decode", take)
    monkeypatch.setattr(mq, "matrix", lambda *_: None)
    monkeypatch.setattr(mq, "lengths", lambda *_: None)
    signal_queries.topology_pipeline(spark, "")
    side = spark.range(mq.BLOCK)
    cells = side.select(F.col("id").cast("int").alias("i")).crossJoin(side.select(F.col("id").cast("int").alias("j")))
    matrix = cells.select(F.lit(0).alias("rec"), F.lit(35).alias("layer"), "i", "j", F.when((F.col("j") - F.col("i")) % 30 == 0, 9.0).otherwise((F.col("i") * 7 + F.col("j")) % 5).alias("v"))
    tracks = mx.fuse_tracks(mx.diagonal_tracks(matrix, taken["most"]))
    assert tracks.select("sep").distinct().count() == mq.BLOCK - 1
    lengths = spark.createDataFrame([(0, mq.BLOCK)], "rec int, length int")
    templates = spark.createDataFrame([(30.0, max(taken["widths"]))], "period double, width int")
    assert wg.start_scores(tracks, lengths, templates).count() == 1
