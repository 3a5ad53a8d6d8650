from collections import Counter

from cadenza.llm import langid


def grams(text):
    row = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
    row = " ".join(["", *row.split(), ""]) if row.split() else ""
    out = Counter(c for c in row if c != " ")
    out.update(row[i : i + 2] for i in range(len(row) - 1))
    out.update(row[i : i + 3] for i in range(len(row) - 2) if row[i + 1] != " ")
    return out


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (1 if c == " " else ord(c))
    return out


def test_gram_codes():
    texts = ["The end. The", "", "42", "é", "a\0b", "x" * 5000, " Über  x9y ", "ends"]
    for text, codes in zip(texts, langid.gram_codes(texts), strict=True):
        assert Counter(codes.tolist()) == Counter({code(g): n for g, n in grams(text).items()}), text


def brute(training, text, top):
    own = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:top]]
    profiles = {lang: {g: k for k, g in enumerate(own(sum((grams(t) for t in texts), Counter())))} for lang, texts in training.items()}
    mine = own(grams(text))
    away = {lang: sum(abs(k - p[g]) if g in p else top for k, g in enumerate(mine)) for lang, p in profiles.items()}
    best = min(away, key=lambda x: (away[x], x))
    return best, 1 - away[best] / (top * len(mine))


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r for r in docs.collect()]
    import zlib

    training: dict = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            training.setdefault(r.lang, []).append(r.text)
    got = {r.doc_id: r for r in langid.identify(docs, 100).collect()}
    for r in rows[:25]:
        want = brute(training, r.text, 100)
        assert (got[r.doc_id].lang_pred, round(got[r.doc_id].score, 9)) == (want[0], round(want[1], 9))


def test_edges_and_columns(spark):
    rows = [(1, "the cat and the dog", "en", 1.0), (3, "der Hund und die Katze", "de", 2.0), (None, None, None, None), (5, "123 !", "en", 0.0), (6, "", None, 0.0), (7, "the dog " * 20000, None, 0.0), (7, "und die", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = langid.identify(docs, 50).collect()
    assert len(out) == len(rows)
    assert {r.text[:7]: r.lang_pred for r in out if r.text} == {"the cat": "en", "der Hun": "de", "123 !": "und", "the dog": "en", "und die": "de"}
    assert all(0 <= r.score <= 1 for r in out)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    out = langid.identify(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out")
    assert out.filter("lang_pred = lang").count() > 0.97 * out.count()


def test_profiles_are_cut_before_the_shuffle(spark, sf_dir):
    profiles = langid.language_profiles(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert "WindowGroupLimit" in profiles._jdf.queryExecution().toString()


def test_many_languages_and_clashing_columns(spark):
    rows = [(i, f"l{i:05d}", f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q " * 3, "mine", True, 7.0) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, lang_pred string, held_out boolean, score double")
    out = langid.identify(docs)
    assert out.columns == docs.columns and out.filter("lang_pred = 'mine' or score > 1").count() == 0
    learnt = out.filter("not held_out")
    assert learnt.filter("lang_pred = lang").count() == learnt.count()
