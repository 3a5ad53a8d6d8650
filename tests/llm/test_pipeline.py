import corpus_pipeline
from cadenza.llm import jaccard, langid
from tests.llm.test_jaccard import brute


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = corpus_pipeline.language(spark, docs, sf_dir)
    assert first.columns == docs.columns
    found = {r.doc_id for r in langid.identify(docs).filter("lang_pred != 'und'").collect()}
    assert {r.doc_id for r in first.collect()} == found == {d for d, t in texts.items() if any(c.isalpha() for c in t or "")}
    second = corpus_pipeline.near_duplicates(spark, jaccard.materialize(first, "t"), sf_dir)
    want = {eval(x)[0] for x in brute([(d, texts[d]) for d in sorted(found)]) if eval(x)[0] == eval(x)[2] or eval(x)[1] == 0}
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == want
    third = corpus_pipeline.mix(spark, jaccard.materialize(second, "t"), sf_dir)
    assert third.columns == docs.columns
    rows = third.collect()
    assert {r.doc_id for r in rows} <= want and all(r.text == texts[r.doc_id] for r in rows)
    last = corpus_pipeline.pack(spark, jaccard.materialize(third, "t"), sf_dir).toPandas()
    assert (last.groupby("doc_id").length.sum() % last.groupby("doc_id").doc_tokens.first() == 0).all()
    assert set(last.doc_id) == {r.doc_id for r in rows}
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(out.ids_crc32) == sorted(last.ids_crc32)
