import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_word_tokenizer_equals_the_tokenizer(texts):
    flat, ends = packing.WordTokenizer(PATH).encode(pa.array(texts, pa.string()))
    own = Tokenizer.from_file(PATH)
    begin = 0
    for text, end in zip(texts, ends, strict=True):
        assert flat[begin:end].tolist() == own.encode(text, add_special_tokens=False).ids
        begin = end


@pytest.mark.parametrize("text", ["It's A-B... don't, we'll!", "É Σας ẞ 12,345.", "<|endoftext|> a<|ENDOFTEXT|>", "a　b c\x1cd", "é x, y,, z's,"])
def test_word_tokenizer_on_edges(text):
    flat, _ = packing.WordTokenizer(PATH).encode(pa.array([text]))
    assert flat.tolist() == ids_of(text)[:-1].tolist()


def test_words_that_differ_in_marks_share_their_parts():
    """Telephone numbers and marked words add no entries of their own; every id stays the tokenizer's."""
    words = [f"(716)-{k}," for k in range(300)] + [f"héllo{m}" for m in (".", ",", "!?", "...", ";")] + ["HÉLLO×3÷ß", "e\u0301a.", "ΣΑΣ.", "l'été's", "\x1c", "\u3000", "<|endoftext|>,B", "a_b<c"]
    coder, own = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    flat, ends = coder.encode(pa.array([" ".join(words), "", *words]))
    begin = 0
    for text, end in zip([" ".join(words), "", *words], ends.tolist(), strict=True):
        assert flat[begin:end].tolist() == own.encode(text, add_special_tokens=False).ids
        begin = end
    assert len(coder.known) < 50


def test_tokenizers_of_another_make_are_refused():
    with pytest.raises(ValueError, match="lower-cased words"):
        packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_the_word_cache_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 3000)
    coder, texts = packing.WordTokenizer(PATH), [" ".join(f"w{k}x{j}," for j in range(20)) for k in range(30)]
    for text in texts + texts:
        assert coder.encode(pa.array([text]))[0].tolist() == ids_of(text)[:-1].tolist()
        assert len(coder.known) < 200


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing_is_what_a_plain_search_gives(lengths):
    lengths = sorted(lengths, reverse=True)
    rooms: list[int] = []
    plain = []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        plain.append(min(fits) if fits else 64)
        if fits:
            rooms.remove(min(fits))
        rooms.append(plain[-1] - n)
    bins, offsets = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    assert [64 - o for o in offsets] == plain
    filled = np.bincount(bins, weights=lengths) if lengths else np.zeros(0)
    assert (filled <= 64).all()


def test_pack_documents(spark):
    rows = [(1, "a b c " * 3000, "x"), (2, None, "x"), (3, "", "y"), (None, "hello, world", "y"), (4, "hello, world", "y"), (4, "hello, world", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    out = packing.pack_documents(docs, PATH, window=512).toPandas()
    for doc_id, text, _ in rows[:3]:
        own = ids_of(text)
        got = out[out.doc_id == doc_id].sort_values("start")
        assert got["length"].sum() == len(own) and (got.doc_tokens == len(own)).all()
        for r in got.itertuples():
            assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    assert len(out[out.doc_id == 4]) == 2 and out.doc_id.isna().sum() == 1
    for _, seq in out.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset == seq.length.cumsum() - seq.length).all() and seq.length.sum() <= 512
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.pack_documents(docs, PATH).toPandas()
    assert out.groupby("sequence_id").padding.first().sum() < 0.02 * out["length"].sum()


def test_a_row_repeated_without_end_is_spread(spark):
    """A third of all rows alike, without id and text: no shard takes them all, and each is packed once."""
    docs = spark.createDataFrame([(None, None)] * 6000 + [(i, f"word {i}") for i in range(12_000)], "doc_id long, text string").repartition(6)
    out = packing.pack_documents(docs, PATH, shard_docs=1000).withColumn("shard", F.shiftright("sequence_id", 32))
    assert out.count() == 18_000 and out.filter("doc_id is null").count() == 6000
    assert out.groupBy("shard").count().agg(F.max("count")).first()[0] < 3000
