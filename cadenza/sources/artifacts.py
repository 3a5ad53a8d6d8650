"""Files that a run depends on: digests against a manifest, and the contract of fixed values.

A manifest holds a line for each file, its SHA-256 in hex, two blanks and its name below the
folder. ``verification`` compares a folder with it as a join, so a folder of many files is
hashed by many tasks; the driver sees faults alone.
"""

from __future__ import annotations

import hashlib
import json
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "cadenza-contract-1"
#: Faults that an error names.
NAMED = 20
_KEYS = {"schema_version", "layers", "spectrum", "local", "topology", "spectrum_control", "teacher_logit", "global_logit"}


def contract_of(text: bytes, digest: str | None = None) -> dict:
    """A contract's values; another digest, another version and missing or unknown keys are errors."""
    observed = hashlib.sha256(text).hexdigest()
    if digest is not None and observed != digest:
        raise ValueError(f"contract digest mismatch: observed {observed}, expected {digest}")
    values = json.loads(text)
    if values.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"unexpected contract version: {values.get('schema_version')}")
    if values.keys() != _KEYS:
        raise ValueError(f"contract keys differ: {sorted(values.keys() ^ _KEYS)}")
    layers = {str(k) for k in values["layers"]}
    if set(values["spectrum"]) != layers or set(values["local"]) != layers:
        raise ValueError("calibrations and layers differ")
    return values


def packaged_contract() -> dict:
    """The contract of this package, checked against its own manifest."""
    folder = resources.files("cadenza") / "assets"
    sums = dict(reversed(line.split("  ", 1)) for line in (folder / "SHA256SUMS").read_text().splitlines())
    return contract_of((folder / "contract.json").read_bytes(), sums["contract.json"])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, expected of a manifest file. A line of another form, and a name that occurs twice, stop the query."""
    line = F.regexp_replace("value", r"\r\z", "")
    lines = spark.read.text(path).select(line.alias("line")).filter(F.trim("line") != "")
    parts = lines.select(F.regexp_extract("line", r"\A([0-9a-fA-F]{64}) [ *](.+)\z", 1).alias("d"), F.regexp_extract("line", r"\A([0-9a-fA-F]{64}) [ *](.+)\z", 2).alias("name"), "line")
    named = parts.select(F.when(F.col("name") != "", F.col("name")).otherwise(F.raise_error(F.concat(F.lit("not a manifest line: "), F.col("line")))).alias("name"), F.lower("d").alias("expected"))
    one = F.when(F.count("*") == 1, F.any_value("expected")).otherwise(F.raise_error(F.concat(F.lit("listed twice: "), F.col("name"))))
    return named.groupBy("name").agg(one.alias("expected"))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of files without bytes below a path or glob, which Spark's file sources leave out; hidden ones are left out here too."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    own = hadoop.Path(path)
    fs, out = own.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for start in fs.globStatus(own) or []:
        files = fs.listFiles(start.getPath(), True)
        while files.hasNext():
            file = files.next()
            if file.getLen() == 0 and file.getPath().getName()[0] not in "._":
                out.append(file.getPath().toString())
    return out


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name, observed, size of a file or of all files below a folder or glob, hashed in parallel. Names are below the folder; a file may hold 2 GB, what a row of Spark takes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("observed"), F.col("length").alias("size"))
    empty = [(p, hashlib.sha256(b"").hexdigest(), 0) for p in _empty_files(spark, path)]
    if empty:
        files = files.union(spark.createDataFrame(empty, "path string, observed string, size long"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath().rstrip("/")
    own = F.regexp_replace("path", r"\A[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    name = F.when(F.startswith(own, F.lit(root + "/")), F.substring(own, len(root) + 2, 1 << 30)).otherwise(F.element_at(F.split(own, "/"), -1))
    return files.select(name.alias("name"), "observed", "size")


def verification(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, status (ok, missing, changed, surplus), expected, observed of every file that is there or is listed."""
    met = wanted.join(found.select("name", "observed"), "name", "full")
    status = F.when(F.col("observed").isNull(), "missing").when(F.col("expected").isNull(), "surplus").when(F.col("expected") != F.col("observed"), "changed").otherwise("ok")
    return met.select("name", status.alias("status"), "expected", "observed")


def require_verified(spark: SparkSession, folder: str, manifest_path: str) -> DataFrame:
    """name, observed, size of a folder's files, all of which are as listed; else an error names the faults, by status and name."""
    found, own = digests(spark, folder), manifest_path.rsplit("/", 1)[-1]
    if manifest_path.rsplit("/", 1)[0] == folder.rstrip("/"):
        found = found.filter(F.col("name") != own)  # a manifest doesn't list itself
    faults = verification(found, manifest(spark, manifest_path)).filter("status <> 'ok'").orderBy("status", "name").limit(NAMED).collect()
    if faults:
        raise ValueError("artifacts differ from the manifest: " + ", ".join(f"{f['status']} {f['name']}" for f in faults))
    return found
