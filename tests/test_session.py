"""The shared folder and size-checked broadcasts, also on a session that names no folder."""

import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from cadenza import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import os
from cadenza.session import clear_work, local_session, materialize, shared_dir
spark = local_session(1, 1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
kept = materialize(spark.range(5), "t")
assert kept.count() == 5
print("folder", shared_dir(spark))
clear_work(spark)
assert not [f for _, _, files in os.walk(shared_dir(spark)) for f in files]
"""


def test_without_a_checkpoint_dir(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], env={**os.environ, "PYTHONPATH": ROOT, "SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not os.path.exists(done.stdout.split("folder ")[1].strip())


def test_a_cluster_must_name_the_folder():
    class Nameless:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_dir(Nameless)


def test_small_side_counts_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    narrow, wide = spark.range(100), spark.range(100).withColumn("s", F.repeat(F.lit("x"), 1000))
    assert hinted(session.small_side(narrow)) and not hinted(session.small_side(narrow, limit=99))
    assert hinted(session.small_side(wide)) and not hinted(session.small_side(wide, most_bytes=50_000))


def test_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for own, want in (("64m", str(session.BATCH_BYTES)), ("1m", "1m")):
            spark.conf.set(key, own)
            session.bounded_batches(spark)
            assert spark.conf.get(key) == want
        long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcd "), 1000).alias("text"))
        assert long.mapInPandas(lambda frames: (f.assign(n=len(f))[["n"]] for f in frames), "n long").agg(F.max("n")).first()[0] < 1000
    finally:
        spark.conf.set(key, before)


def test_a_written_step_leaves_no_shuffle_files():
    """Of two steps, that which drops its shuffles leaves no file of them; the setting is as before."""
    script = """
import glob, sys, time
from cadenza.session import local_session, materialize
from pyspark.sql import functions as F
spark = local_session(2, 4)
root = spark.sparkContext.getConf().get("spark.local.dir")
files = lambda: glob.glob(root + "/**/shuffle_*.data", recursive=True)
wide = spark.range(1000).groupBy(F.col("id") % 7).agg(F.collect_list("id").alias("ids"))
assert materialize(wide, "t", drop_shuffles=True).count() == 7
end = time.time() + 30
while len(files()) > 1 and time.time() < end:  # the count's own
    time.sleep(0.2)
assert len(files()) <= 1, files()
assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
kept = materialize(wide, "t")
assert len(files()) > 1
"""
    with tempfile.TemporaryDirectory() as folder:
        env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": f"--conf spark.local.dir={folder} pyspark-shell"}
        done = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
