"""The pipeline's stages on odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

from collections import Counter

import pytest

import corpus_pipeline
from cadenza.llm import mixing
from tests.llm.test_packing import ids_of

NAMES = ["__gone", "__twice", "__key", "__named", "__mix_source", "__mix_copies", "__lang", "row", "key", "found", "held_out", "lang_pred", "score", "shard", "sequence_id", "size", "u"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
ENGLISH = "the house of the old man and the river that he knew when they were there with all of the others"
GERMAN = "das haus von dem alten mann und der fluss den er kannte als sie dort mit allen den anderen waren"
LONG = " ".join(f"word{k % 997} and the" for k in range(60_000))


def rows():
    own = [
        (1, ENGLISH, "en", "a", 1), (2, ENGLISH + " once more", "en", "a", 1), (3, GERMAN, "de", "b", None), (4, None, "en", "a", 0), (5, "", None, "b", 0), (6, " 12 34 .", "de", None, 3),
        (7, LONG, "en", "b", 9), (8, ENGLISH, "en", None, 1), (8, ENGLISH, "en", None, 1), (9, "short text", None, "c", 2), (9, GERMAN + " und nochmals", "de", "c", 2), (None, ENGLISH, "en", "c", 1),
        (None, None, None, None, None), (10, "another little text about the sea and the sky above it", "en", "", 5),
    ]
    return [(*r, *[f"{n}{k}" for n in NAMES]) for k, r in enumerate(own)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def taken(out):
    return Counter(map(tuple, out.collect()))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_columns_stay_and_empty_tables_are_empty(spark, docs, stage):
    out = stage[1](spark, docs, "")
    assert out.dtypes == docs.dtypes
    known = set(rows())
    assert set(taken(out)) <= known
    empty = stage[1](spark, docs.limit(0), "")
    assert empty.count() == 0 and empty.columns == docs.columns


def test_language_drops_what_has_no_letter(spark, docs):
    out = taken(corpus_pipeline.language(spark, docs, ""))
    assert out == Counter(r for r in rows() if r[1] and any(c.isalpha() for c in r[1]))


def test_near_duplicates_leave_one_of_a_group(spark, docs):
    out = taken(corpus_pipeline.near_duplicates(spark, docs, ""))
    by_id = Counter(r[0] for r in out.elements())
    texts = {(r[0], r[1]) for r in out}
    assert (1, ENGLISH) in texts and by_id[2] == 0 and by_id[8] == 0 and (None, ENGLISH) not in texts
    assert (3, GERMAN) in texts and (9, GERMAN + " und nochmals") not in texts and (9, "short text") in texts
    assert {(4, None), (5, ""), (7, LONG), (None, None)} <= texts and max(out.values()) == 1


def test_mix_takes_rows_by_their_rate(spark, docs):
    out = taken(corpus_pipeline.mix(spark, docs, ""))
    plan = mixing.mix_plan(docs).collect()
    sizes = {r[1]: len((r[1] or "").split()) for r in rows()}
    copies = Counter()
    for r in plan:
        copies[r.doc_id, r.size] += r.copies
    got = Counter()
    for r, n in out.items():
        got[r[0], sizes[r[1]]] += n
    assert got == +copies and sum(r.size for r in plan) == sum(sizes[r[1]] for r in rows())
    long = [r for r in plan if r.doc_id == 7]
    assert long[0].size == sizes[LONG] == 180_000
    assert all(r.copies <= 3 for r in plan) and sum(r.taken for r in plan) == sum(r.size * r.copies for r in plan)


def test_pack_holds_every_token_once(spark, docs):
    out = corpus_pipeline.pack(spark, docs, "").collect()
    want = Counter((r[0], len(ids_of(r[1]))) for r in rows())
    whole = Counter()
    for r in out:
        whole[r.doc_id, r.doc_tokens] += r.length
    assert whole == Counter({k: k[1] * n for k, n in want.items()})
    for own in {r.sequence_id for r in out}:
        pieces = sorted((r.offset, r.length) for r in out if r.sequence_id == own)
        ends = [a + n for a, n in pieces]
        assert [a for a, _ in pieces] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert corpus_pipeline.pack(spark, docs.limit(0), "").count() == 0
