"""A sink that shows rows and their audit together, or nothing.

Rows go as JSON lines to a hidden sibling of the output; its audit, with digests of the inputs
and of each written file, is put beside them, and one rename makes both visible. A run that
fails or is killed leaves the hidden folder alone, which no reader of the output sees, and
which a later run refuses or, with overwrite, removes. All steps go through Spark's own file
systems, so the output may lie wherever Spark writes.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import __version__
from cadenza.sources.artifacts import digests
from cadenza.sources.fasta import write_jsonl

AUDIT = "_audit.json"


def _hadoop(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def partial_path(path: str) -> str:
    """The hidden sibling to which an output is written first."""
    head, _, tail = path.rstrip("/").rpartition("/")
    return f"{head}/.{tail}.partial" if head or path.startswith("/") else f".{tail}.partial"


def combined_digest(spark: SparkSession, path: str) -> str:
    """One SHA-256 over the sorted digests of all files of a path; of a single file, its own."""
    rows = digests(spark, path).groupBy().agg(F.count("*").alias("n"), F.min("observed").alias("one"), F.sha2(F.array_join(F.array_sort(F.collect_list("observed")), ""), 256).alias("all")).first()
    return rows["one"] if rows["n"] == 1 else rows["all"]


def write_audited(rows: DataFrame, path: str, inputs: Sequence[str] = (), overwrite: bool = False, more: dict | None = None) -> dict:
    """Write rows to path, create-exclusive, with an audit in its ``_audit.json``; returns the audit.

    An existing output or partial output is refused unless overwrite is set; an old output
    stays readable until the new one is whole. A failure leaves the partial output and is raised.
    """
    spark = rows.sparkSession
    fs, target = _hadoop(spark, path.rstrip("/"))
    _, partial = _hadoop(spark, partial_path(path))
    there = [str(p) for p in (target, partial) if fs.exists(p)]
    if there and not overwrite:
        raise FileExistsError("refusing to overwrite: " + ", ".join(there))
    fs.delete(partial, True)
    started, began = datetime.now(UTC), time.monotonic()
    known = {name: combined_digest(spark, name) for name in inputs}
    written = write_jsonl(rows, str(partial))
    audit = {
        "started": started.isoformat(), "elapsed_seconds": time.monotonic() - began, "version": __version__, "records": written,
        "input_sha256": known, "output": path, "output_sha256": combined_digest(spark, str(partial) + "/part-*") if written else hashlib.sha256(b"").hexdigest(), **(more or {}),
    }
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(partial, AUDIT), False)
    try:
        out.write(bytearray((json.dumps(audit, indent=1, sort_keys=True, allow_nan=False) + "\n").encode()))
    finally:
        out.close()
    old = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.old") if fs.exists(target) else None
    if old is not None:
        if not overwrite:
            raise FileExistsError(f"refusing to overwrite: {path}")
        fs.delete(old, True)
        fs.rename(target, old)
    if not fs.rename(partial, target):
        raise OSError(f"cannot rename {partial} to {path}")
    if old is not None:
        fs.delete(old, True)
    return audit


def read_audit(spark: SparkSession, path: str) -> dict:
    """The audit of an output that ``write_audited`` made."""
    fs, file = _hadoop(spark, f"{path.rstrip('/')}/{AUDIT}")
    stream = fs.open(file)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()
