"""Session settings, the shared work folder, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a small side is broadcast; beyond it the join is shuffled and AQE splits hot keys.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20

#: Rows of a narrow table that one task writes, where their number is known.
ROWS_PER_FILE = 100_000

#: Bytes of an Arrow batch for Python workers; they and the JVM's buffers hold a batch several times over.
BATCH_BYTES = 2 << 20

#: Settings of Python workers' allocators: large blocks are mapped one by one and go back to the system when freed, for workers outlive their stage.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072", "ARROW_DEFAULT_MEMORY_POOL": "system"}

_own_dir: list[str] = []


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster, spark-submit's settings hold."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where it is unset and all runs in one process on one machine (master local[..], as
    in tests) a temporary folder of this process takes its place; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-shared-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def _work_dir(spark: SparkSession) -> str:
    """This application's own folder inside the shared one; Spark removes it when the application ends."""
    path = f"{shared_dir(spark)}/cadenza-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def clear_work(spark: SparkSession) -> None:
    """Remove all that ``materialize`` has written; results that still read it are void after that."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_work_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Spark's setting that deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, rows: int | None = None, drop_shuffles: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    Unlike cached blocks the files outlive a lost executor, and unlike a checkpoint
    they are columnar, so later readers prune columns. Where a bound on the rows is known,
    tasks and files are as many as these rows need. ``drop_shuffles``: the write's own shuffle
    files go when it ends, so that of several written steps disk holds one step's; Spark by
    itself deletes them when the driver's collector finds their plans unused.
    """
    spark = df.sparkSession
    path = f"{_work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if drop_shuffles:
        spark.conf.set(_CLEANUP, "true")
    try:
        (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))).write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs whose plans are no longer in use, which Spark may put off for half an hour where the driver's heap is large."""
    gc.collect()  # plans that Python objects in cycles hold
    spark._jvm.System.gc()


def _width(df: DataFrame) -> Column:
    """Bytes of a row, about."""
    out = F.lit(8 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        own = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(own), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(own))), F.lit(0))
    return out


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast if it is proven to hold at most ``limit`` rows and about ``most_bytes`` bytes.

    df must be cheap to count (a materialised or aggregated table). A larger one is
    returned as it is: the join is then a sort-merge join whose hot keys AQE splits.
    """
    size = df.select(_width(df).alias("w")).limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= limit and size["b"] <= most_bytes else df


def bounded_side(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast; one that ``small_side`` would not mark is an error. For joins without a key, which have no other way."""
    size = df.select(_width(df).alias("w")).limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("b")).first()
    if size["n"] > limit or size["b"] > most_bytes:
        raise ValueError(f"a list of more than {limit} rows or {most_bytes} bytes can't meet every record: give it the record's key")
    return F.broadcast(df)


def bounded_batches(spark: SparkSession, workers: bool = True) -> None:
    """Cut the Arrow batches of this session's Python functions at BATCH_BYTES, so that rows with long texts don't come by ten thousands; a lower setting stays. Its workers give freed memory back, unless ``workers`` is unset (work on middling arrays is slower by it)."""
    for name, value in WORKER_MEMORY.items() if workers else ():
        spark.sparkContext.environment.setdefault(name, value)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
