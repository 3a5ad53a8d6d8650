"""Record validation as a stream: new FASTA files in, validated rows out, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.functions.sequence import sequence_digest, sequence_status
from cadenza.sources.fasta import parsed, stripped


def fasta_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """record_id, sequence, status, arrived (the file's time) of every record of files that arrive in the folder."""
    reader = spark.readStream.schema("value string").option("lineSep", "\n>").format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.load(folder).select("value", F.col("_metadata.file_modification_time").alias("arrived"))
    rows = parsed(raw.filter(stripped(F.col("value")) != "").select(F.regexp_replace("value", r"\A\s*>", "").alias("value"), "arrived"))
    return rows.withColumns({"status": sequence_status(F.col("sequence")), "sequence_sha256": sequence_digest(F.col("sequence"))})


def mark_repeats(rows: DataFrame, key: str = "record_id", time: str = "arrived", remember: timedelta = timedelta(days=30)) -> DataFrame:
    """A stream's rows with ``occurrence``: how many rows of the same key came before, in this micro-batch or an earlier one.

    The count is state of the query: it outlives restarts from its checkpoint, and is dropped
    when the watermark of the time column has passed a key's last row by ``remember``, so state
    is bounded by the keys of that span. Within a batch rows count in the order of their times
    and other columns. Rows without key are a key; a row later than the watermark is dropped, as
    Spark's stateful operators do.
    """
    columns = rows.columns
    marked = rows.withWatermark(time, f"{int(remember.total_seconds())} seconds")

    def count(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        here = pd.concat(list(batches), ignore_index=True)
        here = here.sort_values([time, *[c for c in columns if c != time]], kind="stable", key=lambda c: c if c.name == time else c.astype(str))
        here["occurrence"] = range(seen, seen + len(here))
        state.update((seen + len(here),))
        last = int(here[time].max().timestamp() * 1000) + int(remember.total_seconds() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield here[[*columns, "occurrence"]]

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", occurrence long"
    return marked.groupBy(key).applyInPandasWithState(count, schema, "n long", "append", GroupStateTimeout.EventTimeTimeout)


def refuse_repeats(rows: DataFrame, key: str = "record_id", time: str = "arrived", remember: timedelta = timedelta(days=30)) -> DataFrame:
    """The stream's rows; a key that came before stops the query and is named."""
    marked = mark_repeats(rows, key, time, remember)
    fault = F.raise_error(F.concat(F.lit("duplicate record: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return marked.withColumn(key, F.when(F.col("occurrence") == 0, F.col(key)).otherwise(fault.cast(dict(rows.dtypes)[key]))).drop("occurrence")


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once by the checkpoint folder; ends when all that is there is read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
