"""Cadenza: a PySpark-native engine for periodic-interval analytics and corpus preparation."""

from cadenza.plans.prediction import predict
from cadenza.sources.fasta import read_fasta, write_jsonl

__version__ = "0.2.0"
__all__ = ["__version__", "predict", "read_fasta", "write_jsonl"]
