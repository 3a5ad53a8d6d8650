"""Strict FASTA reading and JSON-lines writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.sequence import MAXIMUM_LENGTH, record_issues, sequence_digest, strip_stop
from cadenza.session import small_side

#: What separates records where the reader's own separator, a line end and ``>``, doesn't.
_INNER = r"[\r\n]\s*>"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def parsed(raw: DataFrame) -> DataFrame:
    """Chunks of FASTA text without their leading ``>`` (value) -> record_id, sequence, one row a record; other columns stay."""
    others = [c for c in raw.columns if c != "value"]
    each = raw.select(F.explode(F.split("value", _INNER)).alias("value"), *others)
    lines = F.transform(F.split("value", r"\r\n|\r|\n"), stripped)
    head = F.regexp_extract(F.get(lines, F.lit(0)), r"\A(\S*)", 1)
    joined = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "")
    return each.select(head.alias("record_id"), strip_stop(joined).alias("sequence"), *others)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """path -> record_id, sequence, sequence_sha256, length.

    Records are split at ``>`` line starts by the text reader itself, so large files are
    split between tasks. Line ends may be LF, CRLF or CR; white space around lines and blank
    lines are skipped; the id is the header's first word; one trailing stop mark is taken off
    and letters are upper-cased. Text before a file's first header becomes a record without
    id and fails the check below.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    # only a file's first chunk still has its mark, or has none: a row per file
    first = rows.filter("at = 0").groupBy("f").agg(F.min("n").alias("n")).withColumn("begins", F.lit(True))
    marked = rows.join(small_side(first), ["f", "n"], "left").filter(stripped(F.col("value")) != "")
    nameless = F.col("begins") & ~F.col("value").rlike(r"\A\s*>")
    body = F.when(nameless, F.concat(F.lit("\n"), "value")).otherwise(F.regexp_replace("value", r"\A\s*>", ""))
    out = parsed(marked.select(F.coalesce(body, "value").alias("value")))
    return out.withColumns({"sequence_sha256": sequence_digest(F.col("sequence")), "length": F.length("sequence")})


def checked_records(records: DataFrame, maximum: int = MAXIMUM_LENGTH) -> DataFrame:
    """records as they are, if every one is valid; otherwise an error with the counts. One aggregate runs first."""
    issues = record_issues(records, maximum).first().asDict()
    nameless = records.filter(F.col("record_id") == "").limit(1).count()
    bad = {k: v for k, v in issues.items() if v and k != "records"} | ({"without id": nameless} if nameless else {})
    if bad or not issues["records"]:
        raise ValueError(f"invalid records: {bad or 'none found'}")
    return records


def _finite(value: Column, kind: T.DataType) -> Column | None:
    """Whether all numbers in a value of any depth are finite or null; None where it holds none."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.isNull() | (~F.isnan(value) & (F.abs(value) != float("inf")))
    if isinstance(kind, T.StructType):
        parts = [x for f in kind.fields if (x := _finite(value[f.name], f.dataType)) is not None]
        return F.coalesce(F.array_min(F.array(*parts)), F.lit(True)) if parts else None
    if isinstance(kind, (T.ArrayType, T.MapType)):
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        items = value if isinstance(kind, T.ArrayType) else F.map_values(value)
        if _finite(F.lit(None), inner) is not None:
            return F.coalesce(F.forall(items, lambda x: _finite(x, inner)), F.lit(True))
    return None


def _ordered(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs, at any depth, by name."""
    if isinstance(kind, T.StructType) and kind.fields:
        own = F.struct(*[_ordered(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), own)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(value, lambda _, v: _ordered(v, kind.valueType)))))
    return value


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> int:
    """JSON lines, keys sorted at every depth, nulls kept; returns the number of rows.

    An existing path is refused unless overwrite is set; NaN and infinities, however deep,
    stop the write.
    """
    checks = [x for f in rows.schema.fields if (x := _finite(F.col(f.name), f.dataType)) is not None]
    out = rows.select(*[_ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(rows.schema.fields, key=lambda f: f.name)])
    if checks:
        ok = F.array_min(F.array(*checks))
        name = out.columns[0]
        guarded = F.when(ok, _ordered(F.col(name), rows.schema[name].dataType)).otherwise(F.raise_error(F.lit("values must be finite")))
        out = rows.select(guarded.alias(name), *[_ordered(F.col(n), rows.schema[n].dataType).alias(n) for n in out.columns[1:]])
    seen = Observation()
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", "false").mode("overwrite" if overwrite else "errorifexists").json(path)
    return seen.get["n"]
