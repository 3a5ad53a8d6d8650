"""Language identification by rank-order profiles.

A language's profile is its ``top`` most frequent character n-grams (n = 1 to 3 within
words, a word's edges counted as a blank), counted over all training documents. A
document's own most frequent n-grams are compared to each profile by the out-of-place
distance: the sum of rank differences, ``top`` for an n-gram that the profile lacks.
The nearest language is predicted; the score is 1 minus the distance's share of its
maximum.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; equal
distances go to the smaller language code, equal counts to the smaller n-gram; rows
with a null language are not learnt from; a null doc_id counts as training text (its
checksum is that of the empty string); without training text all is ``und``; extra
columns pass through, but for columns named held_out, lang_pred or score, which the
results replace. Whole texts are counted, however long; every task holds the profiles,
``top`` n-grams a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.packing import by_bytes
from cadenza.llm.rows import packed_rows
from cadenza.session import materialize

UNDETERMINED = "und"
#: N-grams of all languages together that the driver and each task may hold, some 100 bytes each.
PROFILE_ROWS = 5_000_000
#: Bytes of text whose n-grams are coded at once; a longer text is coded alone.
SLICE = 400_000
#: Past the last assigned block of letters.
_CODES = 0x32400
_BLANK = 1


@cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter's code point, 0 for all that is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(_CODES):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def gram_codes(texts: list[str]) -> Iterator[np.ndarray]:
    """Codes of all 1-, 2- and 3-grams of each text; a digit of 21 bits per character."""
    joined = " " + " ".join(texts) + " "
    letters = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = letters != 0
    keep[1:] |= letters[:-1] != 0  # a run of other characters is one blank
    keep[0] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    row = letters[keep].astype(np.uint64)
    row[row == 0] = _BLANK
    two = (row[:-1] << np.uint64(21)) | row[1:] if len(row) > 1 else row[:0]
    three = (two[:-1] << np.uint64(21)) | row[2:] if len(row) > 2 else row[:0]
    inner = row[1:-1] != _BLANK if len(row) > 2 else np.zeros(0, bool)
    at = 1
    for text in texts:
        # row positions of the text's letters, with the blank before and the one after
        a, b = int(before[at]), int(before[at + len(text)])
        at += len(text) + 1
        first = a - 1 if a and row[a - 1] == _BLANK else a
        last = b if b and row[b - 1] == _BLANK else b + 1
        one = row[first:last]
        one = one[one != _BLANK]
        if not len(one):
            yield one
            continue
        yield np.concatenate([one, two[first : last - 1], three[first : last - 2][inner[first : last - 2]]])


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def language_profiles(training: DataFrame, top: int = 300) -> DataFrame:
    """training (lang, text) -> lang, gram, rank (from 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b in by_bytes(batch.column(1), SLICE):
                own: dict[str, list[np.ndarray]] = {}
                for lang, codes in zip(langs[a:b], gram_codes(_texts(batch.column(1).slice(a, b - a))), strict=True):
                    own.setdefault(lang, []).append(codes)
                for lang, parts in own.items():
                    grams, n = np.unique(np.concatenate(parts), return_counts=True)
                    if len(grams):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                        )

    counts = training.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    first = counts.withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= top)  # plain, so that it also cuts before the shuffle
    return first.select("lang", "gram", (F.col("__nth") - 1).alias("rank"))


class Profiles:
    """The profiles by n-gram: which languages have it, and at what rank."""

    def __init__(self, table: pd.DataFrame, top: int) -> None:
        self.top = top
        self.langs = sorted(table["lang"].unique())
        table = table.sort_values(["gram", "lang"])
        grams = table["gram"].to_numpy().astype(np.int64)
        self.grams, starts = np.unique(grams, return_index=True)
        self.starts = np.append(starts, len(grams))
        self.lang = np.searchsorted(np.array(self.langs, dtype=object), table["lang"].to_numpy()) if self.langs else np.zeros(0, int)
        self.rank = table["rank"].to_numpy().astype(np.int64)

    def predict(self, codes: np.ndarray) -> tuple[str, float]:
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        grams, n = np.unique(codes.astype(np.int64), return_counts=True)
        own = grams[np.argsort(-n, kind="stable")[: self.top]]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        rank = np.flatnonzero(self.grams[at] == own)
        at = at[rank]
        each = self.starts[at + 1] - self.starts[at]
        entry = np.arange(each.sum()) + np.repeat(self.starts[at] - np.cumsum(each) + each, each)
        # an n-gram that a profile lacks is ``top`` places away: count what the others gain on that
        gain = self.top - np.abs(self.rank[entry] - np.repeat(rank, each))
        away = self.top * len(own) - np.bincount(self.lang[entry], gain, len(self.langs))
        best = int(np.argmin(away))
        return self.langs[best], 1.0 - float(away[best]) / (self.top * len(own))


def identify(docs: DataFrame, top: int = 300) -> DataFrame:
    """docs with held_out, lang_pred and score (which replace columns of these names; all others stay); learnt from the rows that aren't held out.

    The profiles go to every task: languages of more than ``PROFILE_ROWS`` n-grams in all are an error.
    """
    training = docs.filter(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    learnt = materialize(language_profiles(training, top), "language-profiles")
    if learnt.count() > PROFILE_ROWS:
        raise ValueError(f"profiles of more than {PROFILE_ROWS} n-grams: the column lang holds too many values")
    profiles = Profiles(learnt.toPandas(), top)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        column, out = pa.array(texts, pa.string(), from_pandas=True), []
        for a, b in by_bytes(column, SLICE):
            out += [shared.value.predict(codes) for codes in gram_codes(_texts(column.slice(a, b - a)))]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    judged = packed_rows(docs, "doc_id", "text").select("row", is_held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text")).alias("found"))
    own = {"held_out": F.col("held_out"), "lang_pred": F.col("found.lang_pred"), "score": F.col("found.score")}
    placed = [own.get(c, F.col(f"row.`{c}`")) for c in docs.columns]
    return judged.select(*placed, *[v for k, v in own.items() if k not in docs.columns])


def keep_identified(docs: DataFrame, min_score: float = 0.0, top: int = 300) -> DataFrame:
    """The documents whose language is found, with a score of min_score or more; columns unchanged."""
    plain = packed_rows(docs, "doc_id", "text", "lang")
    return identify(plain, top).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")
