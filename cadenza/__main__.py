"""python -m cadenza INPUT.faa OUTPUT: validate records and hash them; with affinities and probabilities, score them; write JSON lines."""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cadenza import __version__
from cadenza.operators.intervals import greedy_batches
from cadenza.operators.ranking import prediction_columns, write_report
from cadenza.plans.prediction import PRIMARY_FIELD, predict
from cadenza.sources.artifacts import SCHEMA_VERSION, require_verified
from cadenza.sources.fasta import checked_records, read_fasta, write_jsonl
from cadenza.sources.sink import write_audited


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cadenza", description=__doc__)
    out.add_argument("input")
    out.add_argument("output", help="folder of JSON lines; its _audit.json appears with them")
    out.add_argument("--maximum-length", type=int, default=2046)
    out.add_argument("--affinities", help="Parquet: record_id, layer, i, j, v")
    out.add_argument("--probabilities", help="Parquet: record_id, global_probability, and state_probability unless logits are given")
    out.add_argument("--logits", help="Parquet: record_id, core_start, channel, ti, tj, logit: outputs of a tile model")
    out.add_argument("--classes", default="", help="names of the logits' class channels, with commas between them")
    out.add_argument("--report", help="folder for the ranked report, tab-separated")
    out.add_argument("--batches", help="folder for the batches in which an outside scorer should take the records (JSON lines)")
    out.add_argument("--maximum-batch", type=int, default=64)
    out.add_argument("--square-budget", type=int, default=4_000_000)
    out.add_argument("--artifacts", help="folder whose files must be as its SHA256SUMS lists them, e.g. the scorer's weights")
    out.add_argument("--overwrite", action="store_true")
    out.add_argument("--quiet", action="store_true")
    out.add_argument("--version", action="version", version=__version__)
    return out


def main(arguments: list[str] | None = None) -> None:
    own = parser()
    args = own.parse_args(arguments)
    if args.input == args.output:
        own.error("input and output must differ")
    if (args.affinities is None) != (args.probabilities is None):
        own.error("affinities and probabilities are given together")
    if args.affinities is None and (args.logits or args.report):
        own.error("logits and the report need affinities and probabilities")
    if bool(args.logits) != bool(args.classes):
        own.error("logits and classes are given together")
    spark = SparkSession.builder.appName("cadenza").getOrCreate()
    started = datetime.now(UTC)
    more = {"schema_version": SCHEMA_VERSION, "primary_score_field": PRIMARY_FIELD, "maximum_length": args.maximum_length, "spark": spark.version}
    if args.artifacts:
        folder = args.artifacts.rstrip("/")
        verified = require_verified(spark, folder, f"{folder}/SHA256SUMS")
        more["artifact_sha256"] = json.loads(verified.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "observed"))))).alias("m")).first()["m"])
    records = checked_records(read_fasta(spark, args.input), args.maximum_length)
    if args.batches:
        write_jsonl(greedy_batches(records.select("record_id", "length"), args.square_budget, args.maximum_batch), args.batches, args.overwrite)
    rows = records
    if args.affinities:
        logits = spark.read.parquet(args.logits) if args.logits else None
        rows = predict(records, spark.read.parquet(args.affinities), spark.read.parquet(args.probabilities), logits, [c for c in args.classes.split(",") if c])
    audit = write_audited(rows, args.output, [args.input], args.overwrite, more)
    ended = datetime.now(UTC)
    line = spark.createDataFrame(
        [(args.input, args.output, audit["records"], started.isoformat(), (ended - started).total_seconds(), __version__)], "input string, output string, records long, started string, elapsed double, version string"
    )
    write_jsonl(line, args.output.rstrip("/") + ".audit", args.overwrite)
    if args.report:
        write_report(spark.read.schema(rows.schema).json(args.output), PRIMARY_FIELD, prediction_columns(), ["record_id"], args.report)
    if not args.quiet:
        print(f"{audit['records']} records written to {args.output}")


if __name__ == "__main__":
    main()
