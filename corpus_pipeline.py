"""Corpus pipeline over documents: language ID, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents: the first drops documents without an identifiable language, the second keeps
one document of each group linked by a shingle similarity of 0.75 or more, the third
repeats or drops documents so that sources come to their target weights, the last cuts
and packs what is left into sequences. Stages with Python functions bound the session's Arrow batches in bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import jaccard, langid, mixing, packing
from cadenza.session import bounded_batches, materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay, columns unchanged.

    A null, empty or letterless text is of no language and goes; a null lang, source or doc_id
    is kept; repeated rows are judged alike and all stay; ties between languages go to the
    first by name; texts of any length are read whole; an empty table gives an empty table.
    """
    bounded_batches(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, columns unchanged.

    It is that with the smallest doc_id (a null one comes last), of equal ids that with the
    smallest set of shingles; of repeated rows one stays. Documents without words are linked
    with nothing and all stay; texts of any length are read whole; an empty table gives an
    empty table.
    """
    bounded_batches(spark)
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, columns unchanged.

    A null source is a source, the last; a document without words goes by its source's rate,
    and a source without any words is not taken; a null doc_id draws by its text; repeated
    rows draw alike; long texts weigh all their words; an empty table gives an empty table.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4,096 tokens: a row per piece.

    A null or empty text has its closing id alone; a null doc_id is packed like any other;
    repeated rows are packed once each; a long text is cut into full windows and a rest; ties
    in length are packed by id; an empty table gives an empty table.
    """
    import public_tokenizers

    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
#: Language profiles, similarity components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is cut off in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
